"""The corpus operators against brute force and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from patternloom.llm import chat, decontaminate, exact_dedup, language_id, packing, quality, simhash, substring_dedup, toxicity, url_filters
from patternloom.llm._common import without_ids
from patternloom.llm._graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, keep_id int, fp string, label int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def docs(spark, rows, langs=("en", "fr")):
    """Rows (doc_id, text), with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, langs[k % len(langs)], "s" + str(k % 3), None, "x", 1, "y", 2) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, copies that differ in case, near copies."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, base = make(45), make(120)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "ONE two"), (7, base), (8, base.upper() if base.isascii() else base), (9, base + " tail"), (10, make(4000))]
    rows += [(20 + k, f"{make(30)} {shared}\n{make(25)}") for k in range(12)] + [(7, base), (40, "rep " * 60), (41, "Rep " * 60), (None, base), (None, None)]
    rows += [(50 + k, " ".join(w for j, w in enumerate(base.split()) if j != k)) for k in range(6)] + [(60, "É é"), (61, "é É"), (62, "\u2003wide space\u00a0x")]
    return docs(spark, rows), rows


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [(1, "x")]).where("doc_id < 0")


@pytest.mark.parametrize("digests", ["all", "surviving"])
def test_exact(awkward, digests):
    table, rows = awkward
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    want = Counter()
    for i, t in rows:
        g = groups[lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        want[i, keep, len(g), i == keep] += 1
    got = exact_dedup.exact_groups(table, digests=digests).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want
    if digests == "all":
        assert {r.digest for r in got} == {hashlib.sha256(k.encode()).hexdigest() for k in groups}
    else:
        assert all(r.digest is not None for r in got if r.group_size > 1)
    kept = exact_dedup.drop_exact_copies(table)
    assert kept.columns == table.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t in rows if i is None or i == max(x for x in groups[lower(t)] if x is not None))


def slow_fingerprint(text):
    w = WORD.findall(lower(text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(fps):
    lab = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    while True:
        new = np.where(near, lab[None, :], len(fps)).min(1)
        if (new == lab).all():
            return lab
        lab = new


def test_simhash(awkward):
    table, rows = awkward
    got = simhash.near_groups(table).collect()
    fp = {lower(t): slow_fingerprint(t) for _, t in rows}
    assert Counter((r.doc_id, r.fp & (2**64 - 1)) for r in got) == Counter((i, fp[lower(t)]) for i, t in rows)
    named = sorted({i: fp[lower(t)] for i, t in rows if i is not None}.items())
    lab = reach(np.array([f for _, f in named], np.uint64))
    want = {i: named[k][0] for (i, _), k in zip(named, lab)}
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    kept = simhash.drop_near_copies(table)
    assert {r.doc_id for r in kept.collect()} - {None} == {i for i, c in want.items() if i == c}


def test_simhash_tiles(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 25, dtype=np.uint64)
    flip = lambda: np.uint64(1) << np.uint64(rng.integers(64))
    f = np.unique(np.concatenate([base] + [base ^ flip() ^ flip() for _ in range(20)]))
    reps = spark.createDataFrame(pd.DataFrame({"node": np.arange(len(f)), "fp": f.view(np.int64)}))
    want = reach(f)
    for segments, tile in ((4, 8192), (4, 3), (8, 40)):
        got = {r.node: r.component for r in components(simhash.links(reps, 2, segments, tile)).collect()}
        assert all(got.get(i, i) == want[i] for i in range(len(f)))


def slow_cut(rows, length=20):
    first, words = {}, {}
    for i, t in rows:
        w = words[i, t] = WORD.findall(t or "")
        for s in range(len(w) - length + 1):
            k, at = tuple(w[s : s + length]), (-1 if i is None else i, s)
            first[k] = min(first.get(k, at), at)
    out = Counter()
    for i, t in rows:
        w = words[i, t]
        gone = {s + j for s in range(len(w) - length + 1) if first[tuple(w[s : s + length])] < (-1 if i is None else i, s) for j in range(length)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_substrings(awkward):
    table, rows = awkward
    got = substring_dedup.substring_dedup(table).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == slow_cut(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_substrings_of_few_words(spark):
    rng = random.Random(8)
    rows = [(i % 37, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 70)))) for i in range(37)]
    got = substring_dedup.substring_dedup(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == slow_cut(rows)


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/private/", "block"), ("example.net", "", "block"), ("a.example.net", "/en/private/x", "allow"), ("org", "/fr/", "allow"), ("org", "/fr/", "block"), (None, "/", "block")]
    table = spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")
    hosts = ["example.net", "A.Example.NET", "example.org", "xexample.net", "net", "org", "b.a.example.net", ""]
    paths = ["", "/", "/en", "/en/", "/en/private/", "/en/private/xy?q#f", "/fr/a", "/FR/", "/en/\U0010ffffz"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/net/", "http://net?x", "a://b://c/", "http://example.net/en/"] * 2
    pages = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(urls)], "page_id long, url string, host string, path string")
    merged = {}
    for h, p, v in rules:
        if h is not None:
            merged[h, p] = max(v, merged.get((h, p), v))
    for size in (1000, 2):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.match_rules(pages, table, group_rows=size).collect()}
        for k, u in enumerate(urls):
            rest = u.split("://", 1)[1] if u and "://" in u else ""
            host, path = lower(re.match(r"[^/?#]*", rest)[0]), re.match(r"[^/?#]*([^?#]*)", rest)[1]
            fits = [(len(h + p), len(h), h + p, v) for (h, p), v in merged.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
            best = max(fits, default=(0, 0, None, "allow"))
            assert got[k] == (host, path, best[2], best[3]), u
    none = url_filters.match_rules(pages.where("page_id < 0"), table)
    assert none.count() == 0
    assert {r.verdict for r in url_filters.match_rules(pages, table.where("rule_host = 'zz'")).collect()} == {"allow"}


def test_contained_items(spark):
    rng = random.Random(4)
    v = [f"w{k}" for k in range(200)]
    items = [(k, " ".join(rng.choice(v) for _ in range(rng.choice([3, 8, 20, 60])))) for k in range(15)] + [(15, ""), (16, None), (3, "w1 w2")]
    rows = [(None, "w1 w2"), (0, None), (1, ""), (2, "w1, W2!")]
    for k in range(60):
        words = [rng.choice(v) for _ in range(rng.randint(0, 300))]
        part = (items[k % 15][1] or "").split()
        for _ in range(k % 4):
            part[rng.randrange(len(part))] = "other"
        at = rng.randint(0, len(words))
        rows.append((10 + k, " ".join(words[:at] + part + words[at:])))
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    want = Counter()
    for i, t in rows:
        own = decontaminate.shingles_of(decontaminate.words_of(t), 5)
        for k, it in items:
            s = decontaminate.shingles_of(decontaminate.words_of(it), 5)
            if s and len(s & own) >= 0.8 * len(s) - 1e-9:
                want[i, k, len(s & own), len(s)] += 1
    table = docs(spark, rows)
    for block in (20_000, 4):
        got = decontaminate.contained_items(table, bench, block_rows=block).collect()
        assert Counter((r.doc_id, r.item_id, r.shared, r.item_shingles) for r in got) == want
    kept = decontaminate.drop_contaminated(table, bench)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in rows if i is None or i not in {k[0] for k in want})


def test_packing(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice([0, 3, 10, 33, 99, 100, 250]), rng.choice([None, "a", "b", "c"]), rng.choice([None, None, 1, 2, k])) for k in range(300)] + [(None, 7, "a", 1), (None, 7, "a", 1), (301, 7, "a", 1)]
    table = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, n int, source string, cluster long, bin_id int, piece int")
    got = packing.best_fit_pack(table, length=F.col("n"), source=F.col("source"), cluster=F.col("cluster"), capacity=100, shard_rows=1000).collect()
    assert sum(r.length for r in got) == sum(r[1] for r in rows)
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    known = {r[0]: r for r in rows}
    for b in bins.values():
        b.sort(key=lambda r: r.offset)
        assert all(x.offset + x.length == y.offset for x, y in zip(b, b[1:])) and b[0].offset == 0 and b[-1].offset + b[-1].length <= 100
        for c in (2, 3):
            seen = [known[r.doc_id][c] for r in b if r.doc_id is not None and known[r.doc_id][c] is not None]
            assert len(seen) == len(set(seen))
    # the tightest compatible bin, as a plain search finds it
    fast, slow = packing.Bins(100), []
    for _ in range(400):
        n, s, c = rng.randint(1, 60), 1 << rng.randint(0, 5), rng.choice([0, 0, 1, 2, 4])
        room = min((b[0] for b in slow if b[0] >= n and not (b[1] & s or b[2] & c)), default=None)
        number, offset = fast.place(n, s, c)
        if room is None:
            assert number == len(slow) and offset == 0
            slow.append([100 - n, s, c])
        else:
            assert slow[number][0] == room and offset == 100 - room and not (slow[number][1] & s or slow[number][2] & c)
            slow[number] = [room - n, slow[number][1] | s, slow[number][2] | c]


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 3, None, "who"), (1, 3, None, "who"), (None, 0, "ann", "x"), (2, 0, "system", "alone"), (3, None, "ann", "first"), (3, 0, "bob", "é")]
    rows += [(9, k, "ann" if k % 2 else "bob", f"t{k}") for k in range(23)]
    table = spark.createDataFrame([(*r, 7, "t") for r in rows], "conv_id long, turn long, role string, text string, chunk int, perspective string")
    got = {(r.conv_id, r.perspective, r.chunk): r for r in chat.rotate(table, chunk_turns=10).collect()}
    assert set(got) == {(1, p, 0) for p in ("ann", "bob", "unknown")} | {(None, "ann", 0), (3, "ann", 0), (3, "bob", 0)} | {(9, p, c) for p in ("ann", "bob") for c in range(3)}
    one = got[1, "ann", 0]
    assert one.text == "<|system|>be kind<|end|><|assistant|>hi <\\|end|><|end|><|user:bob|><|end|><|user:unknown|>who<|end|><|user:unknown|>who<|end|>"
    assert [one.text[m.start : m.end] for m in one.mask] == ["hi <\\|end|><|end|>"] and one.n_turns == 5
    assert [got[9, "bob", c].n_turns for c in range(3)] == [10, 10, 3]
    assert got[3, "ann", 0].text == "<|assistant|>first<|end|><|user:bob|>é<|end|>"
    assert chat.rotate(table.where("conv_id > 100")).count() == 0


def labelled(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = []
    for k in range(n):
        words = [word() for _ in range(rng.randint(5, 60))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            words = [w + "%%%" for w in words]
        if toxic:
            for _ in range(rng.randint(1, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["blorp", "zonk", "grunx"]) + word()[:2])
        rows.append((k, " ".join(words), int(not bad), int(toxic)))
    return rows


def test_classifiers(spark, empty):
    rows = labelled(900, 1)
    table = docs(spark, [(r[0], r[1]) for r in rows] + [(None, None), (5000, "")])
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    got = {r.doc_id: r.score for r in quality.quality(table, labels, usable=usable, bits=14).collect()}
    assert len(got) == len(rows) + 2 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[r[0]] >= 0.7) == (r[2] == 1) for r in rows if held(r[0])]) > 0.97
    got = {r.doc_id: r for r in toxicity.toxicity(table, labels, bits=14, least_rows=5).collect()}
    assert np.mean([(got[r[0]].grade >= 1) == (r[3] == 1) for r in rows]) > 0.97 and got[5000].grade == 0
    assert quality.quality(empty, labels.where("doc_id < 0")).count() == 0 and toxicity.toxicity(empty, labels.where("doc_id < 0")).count() == 0
    assert {r.grade for r in toxicity.toxicity(table, labels.where("toxic = 0")).collect()} == {0}


def test_thresholds_are_ordered():
    rows = labelled(400, 2)
    texts = [r[1] for r in rows]
    grades = toxicity.grade_by_marks(texts, np.array([r[3] for r in rows]))
    assert set(grades.tolist()) == {0, 1, 2}
    m = toxicity.fit_ordinal(texts, grades, bits=14, least_rows=5, steps=100)
    assert m.thresholds[0] < m.thresholds[1]
    s = m.severity(np.linspace(-5, 20, 9))
    assert (np.diff(s) > 0).all() and s[0] >= 0 and s[-1] <= 2


def test_languages(spark, empty):
    rng = random.Random(9)
    letters = {"en": "thewkyg", "fr": "éàçuqle"}
    text = lambda k, n: " ".join("".join(rng.choice(letters[k]) for _ in range(5)) for _ in range(n))
    rows = [(k, text("en" if k % 2 == 0 else "fr", 40)) for k in range(200)]
    table = docs(spark, rows)
    model = language_id.fit_text_model(table)
    probe = spark.createDataFrame(
        [(1, text("en", 30), "a.example.fr", None), (2, text("fr", 30), None, "fr-CA"), (3, None, "x", "en"), (4, "12 !!", "x", "en"), (None, text("fr", 30), "b.example.fr", "en"), (6, "".join(chr(0x4E00 + 7 * k) for k in range(200)), "x", None)],
        "doc_id long, text string, host string, declared string",
    )
    got = {r.doc_id: (r.lang, r.accepted) for r in language_id.identify(probe, model, host_col="host", declared_col="declared").collect()}
    assert got == {1: ("en", True), 2: ("fr", True), 3: (None, False), 4: (None, False), None: ("fr", True), 6: ("und", False)}
    many = spark.createDataFrame([(k, text("fr", 20), "x.site.fr", "fr") for k in range(80)] + [(900, "e l", "y.site.fr", "fr"), (901, "e l", "z.other.com", None)], "doc_id long, text string, host string, declared string")
    p = {r.doc_id: r.posterior["fr"] for r in language_id.identify(many, model, host_col="host", declared_col="declared").collect()}
    assert p[900] > p[901]
    assert language_id.identify(empty, model).count() == 0
    page = spark.createDataFrame([('<!doctype html><HTML class="x" lang="de-AT"><script>var a="<p>";</script><p>Hallo &amp; Welt', "https://u:p@Sub.Example.de:80/x")], "html string, url string")
    r = page.select(language_id.declared_language(F.col("html")).alias("d"), language_id.visible_text(F.col("html")).alias("t"), language_id.host_of(F.col("url")).alias("h")).first()
    assert (r.d, r.t.split(), r.h) == ("de-AT", ["Hallo", "Welt"], "sub.example.de")


def test_empty_tables(empty):
    bench = empty.select(F.col("doc_id").alias("item_id"), "text")
    for out in (exact_dedup.exact_groups(empty), simhash.near_groups(empty), substring_dedup.substring_dedup(empty), decontaminate.contained_items(empty, bench), packing.best_fit_pack(empty), without_ids(empty, empty.select("doc_id"))):
        assert out.count() == 0
