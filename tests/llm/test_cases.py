"""The registered corpus queries and the pipeline's stages on awkward tables, against brute force, and at the edges of their bounds."""

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from patternloom.llm import chat, decontaminate, language_id, packing, quality, simhash, substring_dedup, toxicity
from patternloom.llm import queries as q
from patternloom.llm._common import finished, shared_table
from patternloom.sources import staging

from test_near_copies import roots
from test_operators import lower, reach, slow_cut, slow_fingerprint

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def write(spark, folder, **rows):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(rows.get(name, []), schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders of tables: empty, all null in every column but the text, and mixed."""
    rng = random.Random(2)
    words = [f"{rng.choice('abcdefgh')}{k}" for k in range(80)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(60)
    docs = [(k, text(rng.randint(1, 90)), rng.choice(["en", "fr"]), f"src{k % 3}", 5) for k in range(40)]
    docs += [(50, None, None, None, None), (51, "", "en", "src1", 0), (None, base, "en", None, 1), (None, None, None, None, None), (52, base, "fr", "src0", 1), (52, base, "fr", "src0", 1)]
    docs += [(53, base.upper(), "en", "src1", 1), (54, base + " x", "en", "src1", 1), (55, text(30_000), "fr", "src2", 9)]
    pages = [(1, "http://a.b.example.org/x", f'<html lang="fr"><p>{text(30)}'), (2, None, None), (None, "nothing", text(5)), (1, "http://a.b.example.org/x", f'<html lang="fr"><p>{text(30)}')]
    pages += [(9, "http://e.net/" + "p" * 50_000, "<html lang=>" + text(9000))]
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(40)] + [(3, 0, 1), (None, 1, 1), (50, None, None), (999, 1, 1)]
    bench = [(1, base), (2, None), (None, ""), (3, "a b")]
    talk = [(1, 0, "ann", "hi"), (1, 0, "ann", "hi"), (None, None, None, None), (2, 1, "system", text(9000))]
    out = {"empty": write(spark, tmp_path_factory.mktemp("t") / "e")}
    out["null"] = write(spark, tmp_path_factory.mktemp("t") / "n", documents=[(None, text(30), None, None, None) for _ in range(30)], pages=[(None, None, None)], labels=[(None, None, None)], benchmark=[(None, None)], conversations=[(None,) * 4])
    out["unlabelled"] = write(spark, tmp_path_factory.mktemp("t") / "u", documents=[(k, text(30), None, "s", 1) for k in range(30)], pages=pages)
    out["mixed"] = write(spark, tmp_path_factory.mktemp("t") / "m", documents=docs, pages=pages, labels=labels, benchmark=bench, conversations=talk)
    return out


TABLE = {"op5_url_filters": "pages", "language_id_pages": "pages"}


@pytest.mark.parametrize("kind", ["empty", "null", "unlabelled", "mixed"])
@pytest.mark.parametrize("name", sorted(q.queries()))
def test_queries_on_awkward_tables(spark, tables, name, kind):
    """No crash, and a row for each row wherever the result is by row."""
    out = q.queries()[name](spark, tables[kind]).collect()
    n = {t: spark.read.parquet(f"{tables[kind]}/{t}.parquet").count() for t in ("documents", "pages")}
    if name not in ("op6_decontaminate", "op7_best_fit_packing", "op10_chat_rotation"):
        assert len(out) == (n["documents"] + n["pages"] if name == "op2_language_id" else n[TABLE.get(name, "documents")])
    if name == "op9_quality":
        assert all(r.held_out in (True, False) and 0 <= r.score <= 1 for r in out)
    if kind == "unlabelled":
        if name == "op2_language_id":
            assert not any(r.kept for r in out)
        if name == "op4_toxicity":
            assert not any(r.toxic for r in out)


@pytest.mark.parametrize("kind", ["empty", "null", "unlabelled", "mixed"])
def test_stages_on_awkward_tables(spark, tables, kind):
    docs = spark.read.parquet(f"{tables[kind]}/documents.parquet").withColumns({c: F.lit(1) for c in ("id", "node", "fp", "h", "component", "lid", "row")})
    for name, stage in corpus_pipeline.STAGES:
        out = shared_table(stage(spark, docs, tables[kind]), name)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            if kind in ("null", "unlabelled"):  # rows without ids and documents without known languages stay
                assert out.count() == docs.count()
            if kind == "empty":
                assert out.count() == 0
        docs = out
    run = corpus_pipeline.run(spark, tables[kind])
    plain = [r for r in spark.read.parquet(f"{tables[kind]}/documents.parquet").collect() if r.text]
    assert (run.count() == 0) == (not plain)


def slow_posteriors(rows, model, weight=20.0, unknown=1e-3):
    """Posteriors of (host, declared, text) rows by the docstring, one row at a time; None without letters."""
    size = len(model.languages) + 1
    start = np.log([(1 - unknown) / max(1, size - 1)] * (size - 1) + [unknown])
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    evidence = [sum(model.table[:, g].astype(float) for g in language_id.trigrams(t.encode())) / 3 if t and any(c.isalpha() for c in t) else None for _, _, t in rows]
    own = [None if e is None else soft(e + start) for e in evidence]
    out = []
    for k, (host, declared, _) in enumerate(rows):
        if evidence[k] is None:
            out.append(None)
            continue
        rest = [(rows[j][0], rows[j][1], own[j]) for j in range(len(rows)) if j != k and own[j] is not None]
        total = sum((p for _, _, p in rest), np.zeros(size))
        prior = (total + 1 / size) / (total.sum() + 1)
        if host is not None:
            labels = host.split(".")
            levels = [lambda h: h == host]
            if len(labels) > 1:
                levels = [lambda h: "." in h and h.split(".")[-1] == labels[-1], lambda h: "." in h and h.split(".")[-2:] == labels[-2:], *levels]
            for fits in levels:
                s = sum((p for h, _, p in rest if h is not None and fits(h)), np.zeros(size))
                prior = (s + weight * prior) / (s.sum() + weight)
        logs = np.log(prior) + evidence[k]
        if declared:
            s = sum((p for _, d, p in rest if d == declared), np.zeros(size))
            if s.sum() > 0:
                logs = logs + np.log((s + weight * s.sum() / total.sum()) / (total + weight))
        out.append(soft(logs))
    return out


def test_language_posteriors_by_brute_force(spark):
    rng = random.Random(11)
    letters = {"en": "thewkyg", "fr": "éàçuqle", "de": "schüßen"}
    text = lambda k, n: " ".join("".join(rng.choice(letters[k]) for _ in range(4)) for _ in range(n))
    known = spark.createDataFrame([(k, text(lang, 40), lang) for k, lang in enumerate(["en", "fr", "de"] * 30)], "doc_id long, text string, lang string")
    model = language_id.fit_text_model(known)
    hosts = ["a.b.fr", "c.b.fr", "b.fr", "fr", "x.com", "src1", None]
    rows = [(rng.choice(hosts), rng.choice([None, "fr", "de", "xx"]), text(rng.choice("en fr de".split()), rng.randint(1, 3))) for _ in range(60)] + [("lone.org", "zz", text("fr", 2)), ("a.b.fr", "fr", "12 !"), (None, None, None), ("a.b.fr", "fr", "e l")]
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, host string, declared string, text string")
    got = {r.doc_id: r for r in language_id.identify(table, model, host_col="host", declared_col="declared").collect()}
    names = [*model.languages, "und"]
    for k, want in enumerate(slow_posteriors(rows, model)):
        if want is None:
            assert got[k].lang is None and not got[k].accepted
        else:
            assert np.allclose([got[k].posterior[n] for n in names], want, atol=1e-9), rows[k]
            assert got[k].lang == names[int(want.argmax())] and got[k].accepted == (got[k].lang != "und" and want.max() >= 0.5)


SF = "/root/testdata/sf0.001"


def test_pipeline_by_brute_force(spark):
    """Every stage's kept ids on the smallest tables, with planted near copies and passages, against plain code."""
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    rng = random.Random(4)
    extra = []
    for k in range(12):
        words = docs["text"][k * 7].split()[:200]
        if len(words) > 30:
            for _ in range(1 + len(words) // 60):
                words[rng.randrange(len(words))] = "changed"
        extra.append((100_000 + k, " ".join(words), docs["lang"][k * 7], "src1", 1))
    extra += [(200_000 + k, f"{docs['text'][k * 5][:300]} {bench['text'][k]} {docs['text'][k * 3][:200]}", "en", "src2", 1) for k in range(5)]
    rows = [tuple(r) for r in docs.itertuples(index=False)] + extra
    table = spark.createDataFrame(rows, SCHEMAS["documents"])
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    # language
    left = shared_table(stages["language_id"](spark, table, SF), "a")
    model = language_id.fit_text_model(table)
    post = slow_posteriors([(r[3], None, r[1]) for r in rows], model)
    kept = [r for r, p in zip(rows, post) if p is not None and p.max() >= 0.5 and p.argmax() < len(p) - 1]
    assert ids(left) == sorted(r[0] for r in kept)
    # exact copies
    left = shared_table(stages["exact_dedup"](spark, left, SF), "b")
    last = {}
    for r in kept:
        last[lower(r[1])] = max(r[0], last.get(lower(r[1]), r[0]))
    kept = [r for r in kept if last[lower(r[1])] == r[0]]
    assert ids(left) == sorted(r[0] for r in kept)
    # near copies
    left = shared_table(stages["near_dedup"](spark, left, SF), "c")
    root = roots([(r[0], r[1]) for r in kept])
    assert any(k != v for k, v in root.items())
    kept = [r for r in kept if root[r[0]] == r[0]]
    assert ids(left) == sorted(r[0] for r in kept)
    # benchmark
    left = shared_table(stages["decontaminate"](spark, left, SF), "d")
    items = [decontaminate.shingles_of(decontaminate.words_of(t), 5) for t in bench["text"]]
    dirty = {r[0] for r in kept for own in [decontaminate.shingles_of(decontaminate.words_of(r[1]), 5)] if any(i and len(i & own) >= 0.8 * len(i) - 1e-9 for i in items)}
    assert dirty
    kept = [r for r in kept if r[0] not in dirty]
    assert ids(left) == sorted(r[0] for r in kept)
    # bins
    packed = stages["best_fit_packing"](spark, left, SF).collect()
    n = {r[0]: len(r[1].encode().split()) for r in kept}
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert dict(got) == {k: v for k, v in n.items() if v}
    source, bins = {r[0]: r[3] for r in kept}, defaultdict(list)
    for r in packed:
        bins[r.bin_id].append(r)
    assert all(sum(r.length for r in b) <= 2048 and len({source[r.doc_id] for r in b}) == len(b) for b in bins.values())


def test_simhash_query_by_brute_force(spark):
    rows = pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].sort_values("doc_id")
    fps = np.array([slow_fingerprint(t) for t in rows["text"]], np.uint64)
    lab = reach(fps)
    want = {i: (f"{int(f):016x}", int(rows["doc_id"].iloc[k])) for i, f, k in zip(rows["doc_id"], fps, lab)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in q.op8_simhash(spark, SF).collect()} == want


def test_scores_by_brute_force(spark):
    """Op4 and op9: what Spark's workers score is what the fitted model's formula gives for each text."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts, y = toxicity.training_rows(docs, labels, "toxic", "doc_id", "text", 12_000, rare=1)
    model = toxicity.fit_ordinal(texts, toxicity.grade_by_marks(texts, y))
    got = {r.doc_id: r.severity for r in q.op4_toxicity(spark, SF).collect()}
    for i, t in pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].itertuples(index=False):
        on = {c for w in toxicity.words_of(t) for c in toxicity.columns_of(w, (1 << model.bits) - 1)}
        margin = sum(model.weights[c] for c in on)
        above = [1 - 1 / (1 + np.exp(-np.clip(th - margin, -60, 60))) for th in model.thresholds]  # P(grade > k)
        chances = [1 - above[0], *[a - b for a, b in zip(above, above[1:])], above[-1]]
        assert abs(got[i] - sum(k * p for k, p in enumerate(chances))) < 1e-9
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    texts, y = toxicity.training_rows(docs, labels, "quality", "doc_id", "text", 8_000, ~held)
    m = quality.fit_quality(texts, y)
    got = {r.doc_id: r for r in q.op9_quality(spark, SF).collect()}
    for i, t in pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].itertuples(index=False):
        c = quality.columns_of(t, quality.Tokens(), m.bits)
        x = {int(k): m.ratio[k] for k in c}
        size = np.sqrt(sum(v * v for v in x.values())) or 1.0
        w = {k: m.weights[k] / m.ratio[k] if m.ratio[k] else 0.0 for k in x}
        margin = sum(w[k] * v / size for k, v in x.items()) + m.bias
        p = 1 / (1 + np.exp(-(m.slope * margin + m.shift)))
        assert abs(got[i].score - p) < 1e-6 and got[i].predicted == int(got[i].score >= 0.7)


def test_ordinal_gradient():
    rng = np.random.default_rng(3)
    rows, cols = rng.integers(0, 30, 90), rng.integers(0, 8, 90)
    pairs = np.unique(np.stack([rows, cols]), axis=1)
    rows, cols, grades, heft = pairs[0], pairs[1], rng.integers(0, 4, 30), rng.random(30)
    x, t = rng.normal(size=8), np.array([-0.5, 0.2, -0.3])
    _, gx, gt = toxicity.likelihood(x, t, rows, cols, grades, heft, 0.1)
    loss = lambda x, t: toxicity.likelihood(x, t, rows, cols, grades, heft, 0.1)[0]
    th = toxicity.thresholds_of(t)
    plain = 0.05 * (x**2).sum()
    for i in range(30):
        cdf = [0, *[1 / (1 + np.exp(-(k - sum(x[c] for r, c in zip(rows, cols) if r == i)))) for k in th], 1]
        plain -= heft[i] * np.log(cdf[grades[i] + 1] - cdf[grades[i]])
    assert abs(loss(x, t) - plain) < 1e-9
    for k in range(8):
        e = np.eye(8)[k] * 1e-6
        assert abs((loss(x + e, t) - loss(x - e, t)) / 2e-6 - gx[k]) < 1e-5
    for k in range(3):
        e = np.eye(3)[k] * 1e-6
        assert abs((loss(x, t + e) - loss(x, t - e)) / 2e-6 - gt[k]) < 1e-5


def test_dual_descent_reaches_the_minimum():
    """Against subgradient descent on the primal, on dense data."""
    rng = np.random.default_rng(5)
    n, d = 60, 6
    x = rng.normal(size=(n, d))
    y = np.where(x @ rng.normal(size=d) + rng.normal(size=n) > 0, 1.0, -1.0)
    cost = rng.uniform(0.2, 1.5, n)
    w, b = quality.dual_descent(np.arange(0, n * d + 1, d), np.tile(np.arange(d), n), x.ravel(), y, d, cost, 2000)
    value = lambda w, b: (w @ w + b * b) / 2 + (cost * np.maximum(0, 1 - y * (x @ w + b))).sum()
    v, c, best = np.zeros(d), 0.0, np.inf
    for k in range(1, 30_000):
        on = y * (x @ v + c) < 1
        v, c = v - (v - (cost * y * on) @ x) / k, c - (c - (cost * y * on).sum()) / k
        best = min(best, value(v, c))
    assert value(w, b) <= best + 1e-3 * best


def test_items_are_found_whatever_the_partitions(spark):
    rng = random.Random(7)
    items = [(k, " ".join(f"w{rng.randrange(500)}" for _ in range(20))) for k in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in items], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        got = decontaminate.contained_items(docs, bench.repartition(97, "text"), block_rows=4).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(40)]


def test_repeated_rows_are_dealt_over_shards(spark):
    docs = spark.range(60_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(7).alias("n"), F.lit("s").alias("source"), F.lit(1).alias("c"))
    got = packing.best_fit_pack(docs, length=F.col("n"), source=F.col("source"), cluster=F.col("c"), capacity=100, shard_rows=1000)
    per = got.groupBy(F.shiftright("bin_id", 32).alias("shard")).count().toPandas()["count"]
    assert per.sum() == 60_000 and len(per) == 60 and per.max() < 1500


def test_training_rows_are_bounded(spark):
    docs = spark.range(50_000).select((F.col("id") % 5).alias("doc_id"), F.format_string("text %d", "id").alias("text"))
    labels = spark.range(20_000).select((F.col("id") % 5).alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    texts, y = toxicity.training_rows(docs, labels, "toxic", "doc_id", "text", 5)
    assert len(texts) == len(y) == 5
    assert len(toxicity.training_rows(docs, labels, "toxic", "doc_id", "text", 3)[0]) <= 3
    many = spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1000).alias("text"), (F.col("id") < 20).cast("int").alias("toxic"))
    texts, y = toxicity.training_rows(many, many, "toxic", "doc_id", "text", 100, rare=1)
    assert 60 < len(texts) <= 100 and y.sum() == 20  # all the rare ones
    texts, _ = toxicity.training_rows(many, many, "toxic", "doc_id", "text", 1000, train_bytes=10_500)
    assert len(texts) == 10


def test_rare_labels_flag_no_clean_row(spark):
    """Eleven toxic rows without a mark in common: nothing is flagged."""
    rng = random.Random(1)
    rows = [(k, " ".join(f"v{rng.randrange(5000)}" for _ in range(20)), int(k < 11)) for k in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert {r.grade for r in toxicity.toxicity(table, table).collect()} == {0}


def test_substrings_with_null_ids(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    passage = text(40)
    rows = [(None, f"{text(5)} {passage} {text(k)}") for k in range(30)] + [(None, passage)] * 20 + [(1, passage), (1, passage)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = slow_cut([r for r in rows if r[0] is not None])
    assert Counter(r.n_words for r in got) == Counter(len(t.split()) for _, t in rows)
    assert all(r.n_removed == r.n_words for r in got if r.doc_id == 1) and sum(want.values()) == 2


def test_chat_orders_ties_by_text(spark):
    rng = random.Random(6)
    rows = [(1, 0, "ann", "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))) for _ in range(600)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("chunk").collect()
    said = "".join(r.text for r in got).replace("<|assistant|>", "").split("<|end|>")[:-1]
    assert said == sorted(t for *_, t in rows) and [r.n_turns for r in got] == [256, 256, 88]


def test_finished_leaves_one_table(spark):
    before = set(staging._live)
    out = finished(lambda: simhash.near_groups(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")), "x")
    assert set(staging._live) - before == {out._stage_path} and out.count() == 2
    staging.drop_stage(out)
    assert set(staging._live) == before
