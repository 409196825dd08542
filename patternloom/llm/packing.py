"""Best-fit packing of documents into bins of fixed capacity, under conflicts.

Lengths are counted in words. A document longer than a bin is cut into pieces; pieces that fill a bin are
bins of their own, and the last piece is packed. Two pieces conflict, and never share a bin, when their
documents have the same source or the same duplicate cluster.

Pieces are dealt by hash, with the number of the row in the staged table among its keys, into shards of about
``shard_rows``, and each shard is packed by best-fit decreasing: bins are ordered by residual capacity and carry a bitmap of their sources and one of their
duplicate clusters. From the smallest residual that can hold the piece, successor search goes on to the
next larger one until it finds a compatible bin, which is then the tightest compatible one; without one, a
new bin opens. Bins of equal residual and equal bitmaps are interchangeable and kept together, so a search
looks at classes of bins, and many bins closed to one source cost one look.

Only (id, source, cluster, length) are shuffled, never text; shards hold about the same number of rows
whatever the sources or clusters are. Sharding costs at most the last, part-filled bins of each shard.

Defined cases: documents without words get no piece; a null source or cluster conflicts with nothing; null
ids are packed and reported as null; repeated rows are packed each; an empty table gives no rows; other
columns are not touched. Order within ties: longer first, then smaller id.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, shared_table


class Bins:
    """Bins ordered by residual capacity: at each residual, classes of bins by (sources, clusters) bitmap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.at: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(dict)
        self.residuals = 0  # bit r: some bin has residual r
        self.count = 0
        self.fill: list[int] = []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for a piece; source and cluster are bitmaps with one bit or none."""
        rest = self.residuals >> length
        residual = length
        while rest:
            step = (rest & -rest).bit_length() - 1
            residual += step
            for key, bins in self.at[residual].items():
                if not (key[0] & source or key[1] & cluster):
                    number = bins.pop()
                    if not bins:
                        del self.at[residual][key]
                        if not self.at[residual]:
                            self.residuals ^= 1 << residual
                    return self._put(number, residual - length, key[0] | source, key[1] | cluster, length)
            rest >>= step + 1
            residual += 1
        self.fill.append(0)
        self.count += 1
        return self._put(self.count - 1, self.capacity - length, source, cluster, length)

    def _put(self, number: int, residual: int, sources: int, clusters: int, length: int) -> tuple[int, int]:
        offset = self.fill[number]
        self.fill[number] += length
        if residual:
            self.at[residual].setdefault((sources, clusters), []).append(number)
            self.residuals |= 1 << residual
        return number, offset


def _bits(values: pd.Series, shared_only: bool) -> list[int]:
    """One bit for each value (0 for null and, if ``shared_only``, for values that occur once)."""
    codes, uniques = pd.factorize(values)
    if not shared_only:
        return [1 << int(c) if c >= 0 else 0 for c in codes]
    counts = np.bincount(codes[codes >= 0], minlength=len(uniques))
    bit = np.cumsum(counts > 1) - 1
    return [1 << int(bit[c]) if c >= 0 and counts[c] > 1 else 0 for c in codes]


def _pack(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins = Bins(capacity)
        spots = [bins.place(n, s, c) for n, s, c in zip(rows["length"].tolist(), _bits(rows["source"], False), _bits(rows["cluster"], True))]
        number = np.array([x[0] for x in spots], np.int64)
        out = rows[["id", "piece", "length"]].copy()
        out["bin_id"], out["offset"] = (int(key[0]) << 32) + number, np.array([x[1] for x in spots], np.int64)
        return out[["id", "piece", "length", "bin_id", "offset"]]

    return run


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def content_cluster(text: Column) -> Column:
    """Duplicate cluster of a text by its content, A-Z lower-cased; null for an empty text."""
    return F.when(text != "", F.xxhash64(ascii_lower(text)))


def best_fit_pack(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, source: Column | None = None, cluster: Column | None = None, capacity: int = 2048, shard_rows: int = 20_000) -> DataFrame:
    """id, piece (from 0), start (in the document), length, bin_id, offset (in the bin): one row for each piece."""
    length = n_words(F.col("text")) if length is None else length
    none = F.lit(None)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), length.cast("long").alias("n"),
        (none if source is None else source).cast("string").alias("source"), (none if cluster is None else cluster).cast("long").alias("cluster"),
    )
    rows = shared_table(rows.where("n > 0").withColumn("row", F.monotonically_increasing_id()), "lengths")
    full = rows.where(F.col("n") >= capacity).select("id", F.posexplode(F.sequence(F.lit(1), F.floor(F.col("n") / capacity))).alias("piece", "k"))
    rest = rows.withColumn("length", F.col("n") % capacity).where("length > 0").withColumn("piece", F.floor(F.col("n") / capacity).cast("int"))
    shards = max(1, -(-rest.count() // shard_rows))
    shard = F.pmod(F.xxhash64("id", "source", "cluster", "n", "row"), F.lit(shards)).cast("int")  # row: equal rows do not meet
    schema = "id long, piece int, length long, bin_id long, offset long"
    packed = rest.select("id", "piece", "length", "source", "cluster", shard.alias("shard")).groupBy("shard").applyInPandas(_pack(capacity), schema)
    alone = full.select("id", "piece", F.lit(capacity).cast("long").alias("length"), (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("bin_id"), F.lit(0).cast("long").alias("offset"))
    out = packed.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "piece", (F.col("piece").cast("long") * capacity).alias("start"), "length", "bin_id", "offset")
