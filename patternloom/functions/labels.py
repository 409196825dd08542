"""Names for variables, from the words around them and their type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import let
from .clp import WILDCARD, tokens

# fixed values
AFTER_WORDS = ("in", "after", "took", "elapsed", "waited")
KEYWORDS = (
    "status", "code", "port", "host", "user", "path", "method", "size", "bytes",
    "count", "level", "thread", "pid", "latency", "timeout", "error", "retry", "attempt",
)
UNIT_WORDS = ("ms", "seconds", "s", "minutes", "hours")
BY_TYPE = {"IPv4": "ip", "IPv6": "ip", "UUID": "uuid", "HexID": "id", "Duration": "duration", "Timestamp": "timestamp"}
NUMBERED = {"Integer": "n", "Float": "f", "Enum": "enum", "String": "var"}


def infer_label(template: Column, slot: Column, var_type: Column) -> Column:
    """Label of a slot (from 0): its place is the slot-th token that is a wildcard by itself.

    Variables inside a token have no such place, so the labels of later slots may come from an earlier
    wildcard's surroundings; without a place the type decides.
    """
    def place(words: Column) -> Column:
        return F.get(F.filter(F.transform(words, lambda w, i: F.when(w == WILDCARD, i)), lambda i: i.isNotNull()), slot)

    def around(words: Column) -> Column:
        return let(place(words), lambda at: F.struct(F.lower(F.get(words, at - 1)).alias("before"), F.lower(F.get(words, at + 1)).alias("after")))

    return let(let(tokens(template), around), lambda near: _label(near["before"], near["after"], slot, var_type))


def _label(before: Column, after: Column, slot: Column, var_type: Column) -> Column:
    label = F.when(F.endswith(before, F.lit("=")), F.lower(F.regexp_replace(before, r"[^\p{IsAlphabetic}\p{N}_]", "")))
    label = label.when(before.isin(*AFTER_WORDS), F.when(var_type == "Duration", "duration").otherwise("duration_ms"))
    for word in KEYWORDS:
        label = label.when(F.contains(before, F.lit(word)), word)
    label = label.when(after.isin(*UNIT_WORDS), "duration")
    for name, text in BY_TYPE.items():
        label = label.when(var_type == name, text)
    for name, text in NUMBERED.items():
        label = label.when(var_type == name, F.concat(F.lit(text), (slot + 1).cast("string")))
    return label


def labelled_template(template: Column, labels: Column) -> Column:
    """The template with its stand-alone wildcards replaced, in order, by ``{label}`` while labels last."""
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("k"))

    def step(acc: Column, w: Column) -> Column:
        named = (w == WILDCARD) & (acc["k"] < F.size(labels))
        word = F.when(named, F.concat(F.lit("{"), F.get(labels, acc["k"]), F.lit("}"))).otherwise(w)
        return F.struct(F.concat(acc["out"], F.array(word)).alias("out"), (acc["k"] + named.cast("int")).alias("k"))

    return F.array_join(F.aggregate(tokens(template), zero, step, lambda acc: acc["out"]), " ")


def truncate_token(token: Column, most: int = 50, head: int = 20, tail: int = 10) -> Column:
    """A token of more than 50 bytes as its first 20, ``...`` and its last 10 (whole characters)."""
    size = F.octet_length(token)
    every = F.sequence(F.lit(0), F.length(token))
    first = F.array_max(F.filter(every, lambda n: F.octet_length(token.substr(F.lit(1), n)) <= head))
    last = F.array_max(F.filter(every, lambda n: F.octet_length(F.right(token, n)) <= tail))
    short = F.concat(token.substr(F.lit(1), first), F.lit("..."), F.right(token, last))
    ascii_short = F.concat(F.left(token, F.lit(head)), F.lit("..."), F.right(token, F.lit(tail)))
    return F.when(size <= most, token).when(size == F.length(token), ascii_short).otherwise(short)


def truncate_long_tokens(line: Column) -> Column:
    return F.array_join(F.transform(tokens(line), lambda t: truncate_token(t)), " ")
