"""Clustering against a row-at-a-time model, extraction, statistics, anomalies, correlations, sources."""

import io
import random

import pytest
from pyspark.sql import functions as F

from patternloom.functions import clp
from patternloom.operators import anomalies, correlations, drain, stats
from patternloom.operators.parse import parse_lines
from patternloom.plans.decompose import Decomposition
from patternloom.sources.lines import lines_of_column, lines_of_text, ranked, read_log_files, read_stream, union_sources


def lines(spark, texts):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "line_number long, raw string")


class Model:
    """One pass over all lines, ids counted up: the plain reading of the rules."""

    def __init__(self, children=100, threshold=0.4):
        self.tree, self.templates, self.children, self.threshold = {}, [], children, threshold

    def add(self, words):
        level = self.tree.setdefault(len(words), {})
        first = words[0] if len(words) > 1 else None
        ids = level[first] if first in level else level.get("<*>", []) if first is not None else []
        best = None
        for k in ids:
            t = self.templates[k]
            sim = sum(a == b and a != "<*>" for a, b in zip(t, words)) / len(words) if words else 1.0
            if best is None or (sim, t.count("<*>")) > best[:2]:
                best = (sim, t.count("<*>"), k)
        if best and best[0] >= self.threshold:
            k = best[2]
            self.templates[k] = [a if a == b else "<*>" for a, b in zip(self.templates[k], words)]
            return k
        if first is not None and first not in level:
            room = len(level) < self.children if "<*>" in level else len(level) + 1 < self.children
            if any(c.isnumeric() for c in first) or not room:
                first = "<*>"
        level.setdefault(first, []).append(len(self.templates))
        self.templates.append(list(words))
        return len(self.templates) - 1


@pytest.mark.parametrize("seed", range(3))
def test_clusters_as_in_one_pass(spark, seed):
    rng = random.Random(seed)
    firsts = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(130)] + ["½x", "<*>", "GET"]
    texts = [" ".join([rng.choice(firsts)] + [rng.choice(["x", "y", "z", "q", "r"]) for _ in range(rng.randint(0, 5))]) for _ in range(600)]
    parsed = parse_lines(lines(spark, texts), 2024)
    got = {r.line_number: r.pattern_id for r in drain.assign_patterns(parsed).select("line_number", "pattern_id").collect()}
    model = Model()
    words = {r.line_number: r.w for r in parsed.select("line_number", clp.tokens(F.col("logtype")).alias("w")).collect()}
    want = {i: model.add(words[i]) + 1 for i in sorted(words)}
    assert got == want


@pytest.mark.parametrize("seed", range(20))
def test_leaf_finds_what_a_scan_finds(seed):
    """The bit sets against a scan over all clusters, with few and many slots to a word, and eviction of the oldest."""
    rng = random.Random(seed)
    drain_config = drain.DrainConfig(similarity=rng.choice([0.2, 0.4, 0.7]), max_clusters=rng.choice([5, 50]))
    group, plain = drain.TokenCountGroup(drain_config), []  # clusters, the one used last at the end
    for line in range(500):
        words = [rng.choice("ab")] + [rng.choice("cdefgh") for _ in range(5)]
        rank = lambda c: (sum(a == b and a != "<*>" for a, b in zip(c[1], words)) / 6, c[1].count("<*>"), -c[0])  # noqa: B023, E731
        best = max((c for c in plain if c[2] == words[0]), key=rank, default=None)
        if best is None or rank(best)[0] < drain_config.similarity:
            best = [line, list(words), words[0]]
        else:
            plain.remove(best)
            best[1] = [a if a == b else "<*>" for a, b in zip(best[1], words)]
        plain = [*plain, best][-drain_config.max_clusters :]
        got = group.add(list(words), line)
        assert (got.founder, got.template) == (best[0], best[1])
        assert sorted(group.recent) == sorted(c[0] for c in plain)


@pytest.mark.parametrize("mode", ["replay", "distinct"])
def test_evicted_clusters_found_anew(spark, mode):
    """Three shapes of one length in turn, with room for two: each comes back under a new pattern in replay."""
    texts = [f"{w} x y z" for w in ("one", "two", "three")] * 3
    parsed = parse_lines(lines(spark, texts), 2024)
    rows = drain.assign_patterns(parsed, mode, drain.DrainConfig(max_clusters=2)).collect()
    got = {r.line_number: r.pattern_id for r in rows}
    assert len(rows) == 9 and [got[k] for k in range(1, 10)] == (list(range(1, 10)) if mode == "replay" else [1, 2, 3] * 3)


def test_ranks_over_partitions(spark):
    rng = random.Random(3)
    keys = [rng.randint(0, 50) for _ in range(500)]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    got = ranked(rows, "k", "i").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 501)) and [(r.k, r.i) for r in got] == sorted((k, i) for i, k in enumerate(keys))


def test_templates_cover_their_lines(spark, sample_lines):
    d = Decomposition(lines(spark, sample_lines))
    known = d.templates
    assert drain.match_templates(d.assigned, known).join(d.assigned.select("line_number", F.col("pattern_id").alias("p")), "line_number").where("p <> pattern_id").count() == 0
    assert d.counted.agg(F.sum("count")).first()[0] == len(sample_lines)
    d.close()


def test_distinct_mode(spark, sample_lines):
    d = Decomposition(lines(spark, sample_lines), mode="distinct")
    assert sorted(r["count"] for r in d.counted.collect()) == [3, 3, 14]
    with pytest.raises(ValueError):
        drain.assign_patterns(d.parsed, "other")
    d.close()


def test_variables_stay_in_their_slots(spark):
    d = Decomposition(lines(spark, ["A x 5 y 7", "A x 5.5 y 7", "INFO Starting application", "   ", " \t"]))
    got = {(r.line_number, r.slot): r.raw for r in d.variables.collect()}
    assert got == {(1, 0): "5", (1, 1): "7", (2, 0): "5.5", (2, 1): "7"}
    assert {r.template for r in d.templates.collect()} == {"A x <*> y <*>", "INFO Starting application", ""}
    d.close()


def test_statistics_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, 1 + i % 2, i % 3, str(rng.randint(0, 30)), "Integer") for i in range(400)]
    rows = [(*r, float(r[3])) for r in rows]
    v = spark.createDataFrame(rows, "line_number long, pattern_id long, slot int, raw string, var_type string, num double")
    numbers = {(r.pattern_id, r.slot): r for r in stats.numeric_stats(v).collect()}
    tops, uniques = {}, {(r.pattern_id, r.slot): r.unique_count for r in stats.distinct_counts(v).collect()}
    for r in stats.top_values(stats.slot_values(v), 3).orderBy("rank").collect():
        tops.setdefault((r.pattern_id, r.slot), []).append((r.value, r.n))
    for p in (1, 2):
        for s in (0, 1, 2):
            own = sorted(r[5] for r in rows if r[1] == p and r[2] == s)
            got = numbers[p, s]
            assert (got.num_count, got.min, got.max, got.sum) == (len(own), own[0], own[-1], sum(own))
            assert got.p50 == own[-(-len(own) // 2) - 1]
            raw = [r[3] for r in rows if r[1] == p and r[2] == s]
            assert uniques[p, s] == len(set(raw))
            assert tops[p, s] == sorted(((x, raw.count(x)) for x in set(raw)), key=lambda t: (-t[1], t[0]))[:3]
    close = {(r.pattern_id, r.slot): r.unique_count for r in stats.distinct_counts(v, True).collect()}
    assert all(abs(close[k] - uniques[k]) <= 1 for k in uniques)


def test_spikes_and_r_as_over_the_whole_grid(spark):
    """Sums over the minutes that have lines give what vectors with their zeros give."""
    rng = random.Random(4)
    counts = {p: {m: rng.randint(1, 9) for m in range(40) if rng.random() < 0.3} for p in range(1, 5)}
    counts[1][0], counts[2][39] = 2, 5
    series = {p: [c.get(m, 0) for m in range(40)] for p, c in counts.items()}
    buckets = spark.createDataFrame([(p, m + 1000, n) for p, c in counts.items() for m, n in c.items()], "pattern_id long, minute long, n long")
    ratios = {r.pattern_id: (r.late_ratio, r.early_ratio) for r in anomalies.spike_ratios(buckets).collect()}
    mean = lambda v: sum(v) / len(v)
    for p, v in series.items():
        want = (mean(v[36:]) / mean(v[:36]), mean(v[:4]) / mean(v[4:]))
        assert all(abs(a - b) < 1e-9 for a, b in zip(ratios[p], want))
    chosen = spark.createDataFrame([(p, p, "ERROR" if p == 4 else "x") for p in series], "pattern_id long, rank int, template string")
    got = {(r.pattern_a, r.pattern_b, r.lag): r.r for r in correlations._lagged(buckets, chosen, (0, 2)).collect()}
    for (a, b, lag), r in got.items():
        x, y = series[a][: 40 - lag], series[b][lag:]
        cov = mean([i * j for i, j in zip(x, y)]) - mean(x) * mean(y)
        sd = lambda v: (mean([i * i for i in v]) - mean(v) ** 2) ** 0.5
        assert abs(r - cov / sd(x) / sd(y)) < 1e-9
    assert len(got) == 24


def test_dense_buckets_and_spikes(spark):
    b = spark.createDataFrame([(1, 0, 1), (1, 9, 50), (2, 0, 40), (2, 5, 1), (3, 3, 2)], "pattern_id long, minute long, n long")
    dense = stats.dense_buckets(b)
    rows = {}
    for r in dense.orderBy("pattern_id", "at").collect():
        rows.setdefault(r.pattern_id, []).append(r.n)
    assert rows == {1: [1] + [0] * 8 + [50], 2: [40, 0, 0, 0, 0, 1, 0, 0, 0, 0], 3: [0, 0, 0, 2, 0, 0, 0, 0, 0, 0]}
    found = {r.pattern_id: round(r.severity, 3) for r in anomalies.frequency_spikes(dense).collect()}
    assert found == {1: 1.0, 2: 1.0}


def test_correlations(spark):
    series = {1: [1, 2, 3, 4, 9, 1, 0, 5], 2: [2, 4, 6, 8, 18, 2, 0, 10], 3: [7] * 8, 4: [0, 1, 2, 3, 4, 9, 1, 0]}
    dense = spark.createDataFrame([(p, i, i, n) for p, ns in series.items() for i, n in enumerate(ns)], "pattern_id long, at int, minute int, n long")
    pats = spark.createDataFrame([(1, "a", 10), (2, "b", 9), (3, "c", 8), (4, "ERROR d", 7)], "pattern_id long, template string, count long")
    slots = spark.createDataFrame([(1, 0, "IPv4"), (2, 0, "IPv4"), (3, 0, "String")], "pattern_id long, slot int, var_type string")
    tops = spark.createDataFrame([(1, 0, "x", 1), (1, 0, "y", 2), (2, 0, "x", 1), (3, 0, "x", 1)], "pattern_id long, slot int, value string, rank int")
    got = [(r.pattern_a, r.pattern_b, r.correlation_type, r.description) for r in correlations.find_correlations(pats, slots, tops, dense).collect()]
    assert got[0] == (1, 2, "TemporalCooccurrence", "spike together (r=1.00)")
    assert (1, 2, "SharedVariable", "share IPv4 values") in got
    assert {g for g in got if g[2] == "ErrorCascade"} == {(1, 4, "ErrorCascade", "precedes error by ~1min"), (2, 4, "ErrorCascade", "precedes error by ~1min")}


def test_sources(spark, tmp_path):
    f = tmp_path / "a.log"
    f.write_bytes(b"one\r\n\n two\rstill two\n\xffbad\r\r\nlast")
    got = [(r.line_number, r.raw) for r in read_log_files(spark, str(f)).orderBy("line_number").collect()]
    assert got == [(1, "one"), (2, " two\rstill two"), (3, "\ufffdbad"), (4, "last")]
    assert [(r.line_number, r.raw) for r in read_stream(spark, io.BytesIO(f.read_bytes())).orderBy("line_number").collect()] == got
    text = lines_of_text(spark, "a\r\n\nb\r\r\nc")
    assert [r.raw for r in text.orderBy("line_number").collect()] == ["a", "b\r", "c"]
    table = spark.createDataFrame([(2, "x\ny"), (1, "a\n\nb"), (3, None)], "k int, t string")
    col = lines_of_column(table, "t", "k")
    assert [(r.line_number, r.raw) for r in col.orderBy("line_number").collect()] == [(1, "a"), (2, "b"), (3, "x"), (4, "y")]
    assert [r.raw for r in union_sources(col, text).orderBy("line_number").collect()] == ["a", "b", "x", "y", "a", "b\r", "c"]
    assert lines_of_text(spark, "").count() == 0
