"""Benchmark decontamination: containment search with size-partitioned MinHash sketches, verified exactly.

A benchmark item is found in a document when at least ``threshold`` of the item's distinct five-word shingles
occur anywhere in the document. Words are runs of letters, digits and underscores, lower-cased.

Search. Items are partitioned by their number of distinct shingles, in octaves. An item of n shingles that a
document contains to the threshold t lacks at most floor((1 - t) n) of them there, so of the
floor((1 - t) n) + 1 smallest shingle hashes (its bottom-k MinHash sketch) at least one occurs in the
document. Each partition keeps its items' sketches, of the length its sizes ask for; a document's shingle
hashes above the partition's largest sketch value are pruned before they are looked up. Unlike a banded
index this misses nothing, however long the document is. Every candidate is then verified by comparing the
shingles themselves, as text.

The items are taken in blocks of ``block_rows``, so the sketches a task holds have a fixed bound (each block is one
pass over the documents); documents are neither shuffled nor gathered.

Defined cases: null or empty documents contain nothing; items without words are never found; an item or document
with fewer words than a shingle has one shingle, its whole word sequence; repeated items and repeated rows are
all reported; null ids are reported as null; empty tables give no rows; other columns are not touched.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Rolling, WordHash, shared_table, small_batches, without_ids

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def shingles_of(words: list[str], k: int) -> set[str]:
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def _hashes(words: list[str], seen: WordHash, k: int) -> np.ndarray:
    roll = Rolling(seen.array(words))
    n = len(words)
    return roll.of(np.arange(max(1, n - k + 1)), min(k, n)) if n else np.zeros(0, np.uint64)


class StringHash(WordHash):
    """As WordHash, for strings."""

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _sketches(items: list[tuple], threshold: float, k: int):
    """Per octave of item sizes: sorted sketch values and, for each, the items that hold it."""
    seen, octaves = StringHash(), defaultdict(list)
    for row, (_, text) in enumerate(items):
        words = words_of(text)
        h = np.unique(_hashes(words, seen, k))
        if len(h):
            octaves[len(h).bit_length()].append((row, h[: int((1 - threshold) * len(h) + 1e-9) + 1]))
    out = []
    for group in octaves.values():
        by_value = defaultdict(list)
        for row, sketch in group:
            for v in sketch.tolist():
                by_value[v].append(row)
        out.append((np.array(sorted(by_value), np.uint64), dict(by_value)))
    return out


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 5, threshold: float = 0.8, block_rows: int = 20_000) -> DataFrame:
    """(doc id, item id, shared, item_shingles, containment): every document and item at or over the threshold."""
    spark = docs.sparkSession
    small_batches(spark)
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item_text"))
    n = items.count()
    blocks = max(1, -(-n // block_rows))
    schema = "id long, item_id long, shared int, item_shingles int, containment double"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if blocks > 1:
        block_of = F.pmod(F.xxhash64("item_text", "item_id"), F.lit(blocks))  # of the row alone, however many partitions there are
        items = shared_table(items.withColumn("block", block_of), "items")
    passes = []
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.col("block") == block)
        part = [(r.item_id, r.item_text) for r in part.collect()]  # about block_rows items
        held = spark.sparkContext.broadcast((part, _sketches(part, threshold, k)))
        passes.append(rows.mapInArrow(_search(held, threshold, k), schema))
    return reduce(DataFrame.unionByName, passes).withColumnRenamed("id", id_col)


def _search(held, threshold: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, octaves = held.value
        sets: dict[int, set[str]] = {}
        seen = StringHash()
        for b in batches:
            found = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text)
                h = _hashes(words, seen, k)
                candidates = set()
                for values, by_value in octaves:
                    low = h[h <= values[-1]]
                    at = np.searchsorted(values, low)
                    for v in set(low[values[at] == low].tolist()):
                        candidates.update(by_value[v])
                if candidates:
                    own = shingles_of(words, k)
                    for row in sorted(candidates):
                        if row not in sets:
                            sets[row] = shingles_of(words_of(items[row][1]), k)
                        both = len(sets[row] & own)
                        if both >= threshold * len(sets[row]) - 1e-9:
                            found.append((doc, items[row][0], both, len(sets[row]), both / len(sets[row])))
            cols = list(zip(*found)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["id", "item_id", "shared", "item_shingles", "containment"])

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the documents that contain an item. Rows with a null id stay."""
    found = shared_table(contained_items(docs, items, id_col, text_col, **kw).select(id_col).where(F.col(id_col).isNotNull()).distinct(), "contaminated")
    return without_ids(docs, found, id_col)
