"""Substring deduplication by seed and extend.

A window is ``length`` consecutive words of one document. A window is a repeat when the same word sequence
also starts earlier (smaller id, or same id and earlier start); every word that a repeat covers is removed.
Windows are judged on the input.

Seeds: of the ``length - k + 1`` word k-grams in a window the leftmost with the smallest hash is its anchor
(winnowing), so equal windows have equal anchors at the same place, and about one word in eight is an anchor.
A run is all windows of a document with the same anchor occurrence; they start at consecutive words.

1. Anchors of all documents; hashes that occur twice or more survive (map-side partial counts).
2. Surviving anchors return to their documents, where each is extended both ways to its run: the maximal
   stretch its windows cover. Equal runs are repeats as a whole; the first stays (partial minimum).
3. Where an anchor has several different first runs, these are extended window by window, and of equal
   windows the first stays. This finds where a shared passage ends inside a run.
4. The spans so found are joined with the texts by document.

No step brings the occurrences of one anchor, run or window together in a task: minima and counts are
aggregated map-side, and what is not first is found by an anti-join on (document, start), which is unique.
Documents travel by id and text hash twice; anchors, runs and spans are narrow. Runs and windows are compared by 64-bit
hashes, and only with those that have the same 64-bit anchor hash: texts that differ outside the anchor are told
apart by the one hash.

Defined cases: null or empty text has no words; a null id sorts before all others; rows that repeat an id
are told apart by their text, and rows with equal id and text are one document (each is reported, and they
are no repeats of each other); other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Rolling, WordHash, discard, shared_table, small_batches

LENGTH, SEED = 20, 6
_SPANS = "array<struct<start:int,n:int>>"


def _runs(texts: list[bytes], hashes: WordHash, length: int, k: int):
    """Rolling hashes over the words of all texts; per run: document index, anchor position, first start,
    number of windows (positions count over all texts), and where each text's words begin."""
    words = [t.split() if t else [] for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.concatenate(([0], np.cumsum(counts)))
    roll = Rolling(hashes.array([w for ws in words for w in ws]))
    n, width = roll.n, length - k + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return roll, none, none, none, none, begins
    grams = roll.of(np.arange(n - k + 1), k)
    windows = n - length + 1
    least, at = grams[:windows].copy(), np.zeros(windows, np.int64)
    for j in range(1, width):
        part = grams[j : j + windows]
        less = part < least
        least[less] = part[less]
        at[less] = j
    start = np.arange(windows)
    at += start
    doc = np.repeat(np.arange(len(words)), counts)[:windows]
    valid = start + length <= begins[1:][doc]
    start, at, doc = start[valid], at[valid], doc[valid]
    first = np.ones(len(start), bool)
    first[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(first)
    return roll, doc[heads], at[heads], start[heads], np.diff(np.append(heads, len(start))), begins


def _anchors(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            roll, doc, at, _, _, begins = _runs(b.column(1).cast(pa.binary()).to_pylist(), hashes, length, k)
            anchor = roll.of(at, k).view(np.int64)
            pos = pa.array((at - begins[doc]).astype(np.int32))
            took = pa.array(doc)
            yield pa.record_batch([b.column(0).take(took), b.column(2).take(took), pa.array(anchor), pos], names=["id", "tk", "anchor", "pos"])

    return run


def _extended(length: int, k: int):
    """Runs whose anchor survives, each with its content hash and the hashes of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            roll, doc, at, start, n, begins = _runs(texts, hashes, length, k)
            lists = b.column("positions")
            wanted = np.zeros(begins[-1] + 1, bool)
            where = lists.flatten().to_numpy(zero_copy_only=False)
            wanted[np.minimum(where + np.repeat(begins[:-1], np.diff(lists.offsets.to_numpy())), begins[-1])] = True
            on = wanted[at]
            doc, at, start, n = doc[on], at[on], start[on], n[on]
            content = roll.of(start, n + length - 1)
            each = np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            windows = pa.ListArray.from_arrays(pa.array(ends), pa.array(roll.of(each, length).view(np.int64)))
            took = pa.array(doc)
            yield pa.record_batch(
                [b.column("id").take(took), b.column("tk").take(took), pa.array(roll.of(at, k).view(np.int64)), pa.array(content.view(np.int64)), pa.array((start - begins[doc]).astype(np.int32)), pa.array((at - start).astype(np.int32)), pa.array(n.astype(np.int32)), windows],
                names=["id", "tk", "anchor", "content", "start", "lead", "n", "windows"],
            )

    return run


def repeat_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = SEED) -> DataFrame:
    """(id, tk, spans): per document that has repeats, the runs of consecutive repeated windows (start, n) in
    words; a run covers words start to start + n + length - 2. tk is the hash of the document's text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tk", F.xxhash64("text"))
    anchors = shared_table(rows.mapInArrow(_anchors(length, k), "id long, tk long, anchor long, pos int"), "anchors")
    twice = shared_table(anchors.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "seeds")
    # by document, that is by id and text: a set, so that rows that repeat a document add nothing
    seeds = anchors.join(twice, "anchor", "left_semi").groupBy("id", "tk").agg(F.collect_set("pos").alias("positions"))
    seeds = shared_table(seeds.select(F.col("id").alias("sid"), F.col("tk").alias("stk"), "positions"), "positions")
    texts = rows.join(seeds, F.col("id").eqNullSafe(F.col("sid")) & (F.col("tk") == F.col("stk"))).select("id", "tk", "text", "positions")
    schema = "id long, tk long, anchor long, content long, start int, lead int, n int, windows array<long>"
    runs = shared_table(texts.mapInArrow(_extended(length, k), schema), "runs")
    discard(anchors, twice, seeds)
    place = F.struct("id", "start", "tk")
    key = ["anchor", "content", "n", "lead"]
    firsts = shared_table(runs.groupBy(*key).agg(F.min(place).alias("at")), "first-runs")
    spot = lambda c: [F.col(f"{c}.id").alias("fid"), F.col(f"{c}.start").alias("fstart"), F.col(f"{c}.tk").alias("ftk")]
    same = F.col("id").eqNullSafe(F.col("fid")) & (F.col("start") == F.col("fstart")) & F.col("tk").eqNullSafe(F.col("ftk"))
    copies = runs.select("id", "tk", "start", "n").join(firsts.select(*spot("at")), same, "left_anti")
    several = firsts.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    open_runs = firsts.join(shared_table(several, "open-anchors"), "anchor", "left_semi").select(*spot("at"))
    first = runs.join(open_runs, same, "left_semi").select("id", "tk", "anchor", "lead", "start", F.posexplode("windows").alias("o", "window"))
    windows = first.select("id", "tk", "anchor", (F.col("lead") - F.col("o")).alias("lead"), "window", (F.col("start") + F.col("o")).alias("start"))
    windows = shared_table(windows.distinct(), "open-windows")  # rows with equal id and text give the same ones
    least = windows.groupBy("anchor", "lead", "window").agg(F.min(place).alias("at"))
    parts = windows.select("id", "tk", "start", F.lit(1).alias("n")).join(least.select(*spot("at")), same, "left_anti")
    spans = copies.unionByName(parts).groupBy("id", "tk").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    spans = shared_table(spans, "spans")
    discard(runs, firsts, windows)
    return spans


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, digests, kept_text = [], [], [], []
            for text, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist()):
                words = text.split() if text else []
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    start = np.fromiter((s["start"] for s in spans), np.int64, len(spans))
                    n = np.fromiter((s["n"] for s in spans), np.int64, len(spans))
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n + length - 1, -1)
                    keep = np.cumsum(edge)[:-1] == 0
                    kept = [w for w, k in zip(words, keep.tolist()) if k]
                else:
                    kept = words
                whole = b" ".join(kept)
                total.append(len(words))
                gone.append(len(words) - len(kept))
                digests.append(hashlib.sha256(whole).hexdigest())
                kept_text.append(whole)
            cols = [b.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_text, pa.binary()).cast(pa.string())]
            yield pa.record_batch(cols, names=["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = SEED) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256, kept_text (kept words, one space apart)."""
    spans = repeat_spans(docs, id_col, text_col, length, k).select(F.col("id").alias("sid"), "tk", "spans")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    same = F.col("id").eqNullSafe(F.col("sid")) & (F.xxhash64("text") == F.col("tk"))
    out = rows.join(spans, same, "left").select("id", "text", "spans")
    return out.mapInArrow(_cut(length), "id long, n_words long, n_removed long, kept_sha256 string, kept_text string").withColumnRenamed("id", id_col)
