"""Clustering logtypes into templates: a fixed-depth prefix tree with first-come-first-served clusters.

Only lines with equally many tokens ever meet, so the sequential part runs per token count: lines travel as (number,
logtype hash), with the logtype only where it is met first, sorted by the shuffle, and are read as a stream. What a
task holds grows with the clusters and with the logtypes that occur more than once, not with the lines. Cluster
ids are the ranks of the lines that founded the clusters, as a single pass over all lines would number them.

Two modes. ``replay`` goes through every line in order, which is what a single pass does. ``distinct`` goes
through every distinct logtype once, in order of first appearance: its streams grow with the number of
logtypes and not of lines, so it is the one for very large inputs. The two can differ, because a template
that has gained wildcards may no longer be similar enough to a logtype it took before.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clp import SPACE, WILDCARD, tokens
from ..sources.lines import ranked
from ..sources.staging import drop_stage, sized, stage


@dataclass(frozen=True)
class DrainConfig:
    similarity: float = 0.4
    max_children: int = 100
    max_clusters: int = 10_000


class _Cluster:
    __slots__ = ("founder", "leaf", "slot", "template", "wild")

    def __init__(self, founder: int, template: list[str]):
        self.founder, self.template = founder, template
        self.wild = template.count(WILDCARD)


class Leaf:
    """The clusters of a leaf, found by how many words they have in the same places.

    For every place and word: the clusters that have it there, as the complement of one slot, a list of several or, over
    ``few``, a bit set. Counting adds the bit sets up in binary, digit by digit, so all clusters of a leaf are counted
    at once.
    """

    few = 8

    def __init__(self):
        self.slots: list[_Cluster | None] = []
        self.free: list[int] = []
        self.having: list[dict[str, int | list[int]]] = []

    def add(self, cluster: _Cluster) -> None:
        cluster.leaf = self
        if self.free:
            slot = self.free.pop()
            self.slots[slot] = cluster
        else:
            slot = len(self.slots)
            self.slots.append(cluster)
        cluster.slot = slot
        while len(self.having) < len(cluster.template):
            self.having.append({})
        for place, word in zip(self.having, cluster.template):
            if word == WILDCARD:
                continue
            now = place.get(word)
            if now is None:
                place[word] = ~slot
            elif type(now) is list:
                now.append(slot)
                if len(now) > self.few:
                    place[word] = sum(1 << s for s in now)
            elif now < 0:
                place[word] = [~now, slot]
            else:
                place[word] = now | 1 << slot

    @staticmethod
    def _take(place: dict, word: str, slot: int) -> None:
        now = place[word]
        if type(now) is list:
            now.remove(slot)
            if len(now) == 1:
                place[word] = ~now[0]
        elif now >= 0 and (now := now ^ 1 << slot):
            place[word] = now
        else:
            del place[word]

    def remove(self, cluster: _Cluster) -> None:
        for place, word in zip(self.having, cluster.template):
            if word != WILDCARD:
                self._take(place, word, cluster.slot)
        self.slots[cluster.slot] = None
        self.free.append(cluster.slot)

    def widen(self, cluster: _Cluster, words: list[str]) -> bool:
        """Make wildcards of the places where the words differ from the cluster's template; whether there were any."""
        changed = False
        for at, (a, b) in enumerate(zip(cluster.template, words)):
            if a != b and a != WILDCARD:
                self._take(self.having[at], a, cluster.slot)
                cluster.template[at] = WILDCARD
                cluster.wild += 1
                changed = True
        return changed

    def best(self, words: list[str], least: float) -> _Cluster | None:
        """The cluster with most words in common, if their share is ``least``: of several the one with most wildcards,
        then the oldest."""
        n = len(words)
        digits: list[int] = []  # of the counts of all slots, lowest first
        found = [now for place, word in zip(self.having, words) if (now := place.get(word)) is not None]
        if n and len(found) / n < least:
            return None
        for carry in found:
            if type(carry) is list:
                carry = sum([1 << s for s in carry])
            elif carry < 0:
                carry = 1 << ~carry
            for d, digit in enumerate(digits):
                digits[d], carry = digit ^ carry, digit & carry
                if not carry:
                    break
            if carry:
                digits.append(carry)
        most, top = 0, -1
        for d in range(len(digits) - 1, -1, -1):
            if top & digits[d]:
                top &= digits[d]
                most += 1 << d
        if most / n < least if n else False:
            return None
        if top < 0:  # nothing in common with any: all are alike
            found = [c for c in self.slots if c is not None]
        else:
            found = []
            while top:
                low = top & -top
                found.append(self.slots[low.bit_length() - 1])
                top ^= low
        return max(found, key=lambda c: (c.wild, -c.founder), default=None)


class TokenCountGroup:
    """The clusters of all lines with one token count."""

    def __init__(self, config: DrainConfig):
        self.config = config
        self.leaves: dict[str, Leaf] = {}
        self.recent: OrderedDict[int, _Cluster] = OrderedDict()
        self.version = 0  # changes whenever an assignment could

    def _home(self, words: list[str]) -> Leaf:
        """Where a new cluster goes: its first word's leaf, or the wildcard's when that word has digits or
        there is no room for another."""
        first = words[0] if len(words) > 1 else ""
        if first not in self.leaves and len(words) > 1:
            spare = self.config.max_children - (WILDCARD not in self.leaves)
            if any(c.isnumeric() for c in first) or len(self.leaves) >= spare:
                first = WILDCARD
        return self.leaves.setdefault(first, Leaf())

    def find(self, words: list[str]) -> _Cluster | None:
        first = words[0] if len(words) > 1 else ""
        leaf = self.leaves.get(first)
        if leaf is None and len(words) > 1:
            leaf = self.leaves.get(WILDCARD)
        return None if leaf is None else leaf.best(words, self.config.similarity)

    def add(self, words: list[str], line: int) -> _Cluster:
        """Cluster of a line, which it joins or founds."""
        c = self.find(words)
        if c is None:
            c = _Cluster(line, list(words))
            self._home(words).add(c)
            self.recent[line] = c
            self.version += 1
            if len(self.recent) > self.config.max_clusters:
                _, gone = self.recent.popitem(last=False)
                gone.leaf.remove(gone)
        else:
            self.version += c.leaf.widen(c, words)
            self.recent.move_to_end(c.founder)
        return c


_SPACES = re.compile(SPACE + "+")


def words_of(logtype: str) -> list[str]:
    """The tokens of a logtype, as :func:`..functions.clp.tokens` gives them."""
    if _CONTROLS.isdisjoint(logtype):
        return logtype.split()
    return [w for w in _SPACES.split(logtype) if w]


_CONTROLS = frozenset("\x1c\x1d\x1e\x1f")  # blanks to Python only


def _first_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tc, line_number, h, logtype, again) whose h is new in the partition."""
    seen: set[int] = set()
    for b in batches:
        new = [i for i, h in enumerate(b.column("h").to_pylist()) if not (h in seen or seen.add(h))]
        yield b.take(pa.array(new, pa.int64()))


def _replay(config: DrainConfig, each: bool):
    """Over rows (tc, line_number, h, logtype, again) sorted by tc and line_number: the logtype where h is new, and whether it
    comes again. Without ``each`` only the first row of a logtype counts and is answered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, known, dictionary = None, None, {}, {}
        for b in batches:
            out, rows = [], []
            for i, (tc, line, h, logtype, again) in enumerate(zip(*(c.to_pylist() for c in b.columns))):
                if tc != now:
                    now, group, known, dictionary = tc, TokenCountGroup(config), {}, {}
                seen = known.get(h)
                if not each:
                    if seen is not None:
                        continue
                    known[h] = ()
                    out.append(group.add(words_of(logtype), line).founder)
                    rows.append(i)
                    continue
                if logtype is not None and again:
                    dictionary[h] = words_of(logtype)
                if seen is not None and seen[1] == group.version:
                    cluster = seen[0]
                    group.recent.move_to_end(cluster.founder)
                else:
                    cluster = group.add(dictionary[h] if again else words_of(logtype), line)
                    if again:
                        known[h] = (cluster, group.version)
                out.append(cluster.founder)
                rows.append(i)
            took = pa.array(rows, pa.int64())
            yield pa.record_batch([b.column(1).take(took), b.column(2).take(took), pa.array(out, pa.int64())], names=["line_number", "h", "founder"])

    return run


def assign_patterns(parsed: DataFrame, mode: str = "replay", config: DrainConfig = DrainConfig()) -> DataFrame:
    """``parsed`` (line_number, logtype, ...) with ``pattern_id``. ``parsed`` is read several times: stage it.

    Logtypes whose lines are all of one pattern, which is nearly all of them, are joined by the logtype's hash, the
    lines of the others by number; either table is broadcast only if it is small.
    """
    if mode not in ("replay", "distinct"):
        raise ValueError(f"mode is 'replay' or 'distinct', not {mode!r}")
    h = F.xxhash64("logtype").alias("h")
    tc = F.size(tokens(F.col("logtype"))).alias("tc")
    if mode == "distinct":
        lines = parsed.select(tc, "line_number", h, "logtype", F.lit(False).alias("again"))
        lines = lines.mapInArrow(_first_of_partition, lines.schema)
    else:
        dictionary = parsed.groupBy("logtype").agg(F.min("line_number").alias("line_number"), (F.count("*") > 1).alias("again"))
        lines = stage(dictionary.select(tc, "line_number", h, "logtype", "again"), "dictionary")
        first = lines.where("again").select(F.col("h").alias("h1"), "tc", F.col("line_number").alias("first"))
        later = parsed.select("line_number", h).join(sized(first), F.col("h") == F.col("h1")).where(F.col("line_number") != F.col("first"))
        later = later.select("tc", "line_number", "h", F.lit(None).cast("string").alias("logtype"), F.lit(True).alias("again"))
        lines = lines.unionByName(later)
    in_order = lines.repartition("tc").sortWithinPartitions("tc", "line_number")
    places = stage(in_order.mapInArrow(_replay(config, mode == "replay"), "line_number long, h long, founder long"), "places")
    numbers = stage(ranked(places.select("founder").distinct(), "founder").select("founder", F.col("rank").alias("pattern_id")), "numbers")
    by_type = places.groupBy("h").agg(F.min("founder").alias("founder"), F.max("founder").alias("other"))
    by_type = stage(by_type.join(sized(numbers), "founder").select("h", F.when(F.col("founder") == F.col("other"), F.col("pattern_id")).alias("pattern_id")), "by-type")
    mixed = places.join(by_type.where("pattern_id IS NULL").select("h"), "h", "left_semi")
    by_line = stage(mixed.join(sized(numbers), "founder").select(F.col("line_number").alias("n1"), F.col("pattern_id").alias("p1")), "by-line")
    out = parsed.join(sized(by_type.where("pattern_id IS NOT NULL")), F.xxhash64("logtype") == F.col("h"), "left").drop("h")
    out = out.join(sized(by_line), F.col("line_number") == F.col("n1"), "left").withColumn("pattern_id", F.coalesce("pattern_id", "p1")).drop("n1", "p1")
    drop_stage(places, numbers)
    return out


def templates(assigned: DataFrame) -> DataFrame:
    """pattern_id, words, token_count: a place is a wildcard if the pattern's lines differ there."""
    kinds = assigned.groupBy("pattern_id", "logtype").agg(F.lit(1).alias("x")).select("pattern_id", tokens(F.col("logtype")).alias("w"))
    empty = kinds.where(F.size("w") == 0).select("pattern_id").distinct().select("pattern_id", F.array().cast("array<string>").alias("words"))
    places = kinds.select("pattern_id", F.posexplode("w").alias("at", "word")).groupBy("pattern_id", "at").agg(F.min("word").alias("a"), F.max("word").alias("b"))
    word = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(WILDCARD)
    full = places.groupBy("pattern_id").agg(F.array_sort(F.collect_list(F.struct("at", word.alias("word")))).alias("p")).select("pattern_id", F.col("p.word").alias("words"))
    return full.unionByName(empty).select("pattern_id", "words", F.size("words").alias("token_count"))


def match_templates(parsed: DataFrame, known: DataFrame) -> DataFrame:
    """Lines whose tokens all equal a known template's or meet a wildcard there: (line_number, pattern_id), the
    template with most wildcards and then the smallest id winning. Joined by token count and, where the template's
    first word is fixed, by that word too."""
    lines = parsed.select("line_number", tokens(F.col("logtype")).alias("w"))
    lines = lines.select("line_number", "w", F.size("w").alias("n"), F.explode(F.array_distinct(F.array(F.coalesce(F.get("w", F.lit(0)), F.lit("")), F.lit(WILDCARD)))).alias("first"))
    rules = known.select("pattern_id", "words", F.size("words").alias("n"), F.coalesce(F.get("words", F.lit(0)), F.lit("")).alias("first"))
    fits = F.forall(F.zip_with("w", "words", lambda a, b: (a == b) | (b == WILDCARD)), lambda x: x)
    wild = F.size(F.filter("words", lambda x: x == WILDCARD))
    found = lines.join(rules, ["n", "first"]).where(fits).groupBy("line_number").agg(F.max(F.struct(wild, -F.col("pattern_id"))).alias("best"))
    return found.select("line_number", (-F.col("best.col2")).alias("pattern_id"))
