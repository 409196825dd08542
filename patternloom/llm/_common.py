"""What the corpus operators share: tables in the shared folder, set differences by id, word hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import drop_stage as discard
from ..sources.staging import finished, partitions_for, sized
from ..sources.staging import stage as shared_table

__all__ = ["discard", "finished", "partitions_for", "shared_table", "sized"]

#: Ids below this count are broadcast (8 bytes each); above it the join is shuffled.
BROADCAST_ROWS = 1_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Bound what an Arrow batch of whole texts holds; a session that bounds it more tightly is left alone."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        try:
            now = int(re.sub(r"\D", "", spark.conf.get(key)))
        except Exception:  # a Spark without the setting
            continue
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in ``ids`` (one column). A short list, as counted, is broadcast; a
    longer one is joined by shuffle. Rows with a null id stay."""
    ids = ids.select(F.col(ids.columns[0]).alias("__gone"))
    few = ids.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids, docs[id_col] == F.col("__gone"), "left_anti")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Where a text is all ASCII that is plain ``lower``, which is much faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


class WordHash(dict):
    """XXH64 of words (bytes), remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser, vectorised."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                up = np.full(size, _BASE, np.uint64)
                down = np.full(size, pow(_BASE, -1, 2**64), np.uint64)
                up[0] = down[0] = 1
                self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


POWERS = Powers()


class Rolling:
    """Hashes of any run of words in O(1) each, after one cumulative sum over the word hashes."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        up, self.down = POWERS.get(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(words * up[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.down[start] + np.asarray(length, np.uint64))
