"""SimHash near-duplicate groups by tiled exact comparison.

A fingerprint has 64 bits; bit b is set when more than half of the hashes of the text's word shingles
(repeats included) have it set. Documents link when their fingerprints differ in ``radius`` bits or fewer,
and groups are the connected components.

All pairs within the radius are found exactly. Equal fingerprints are first collapsed to one row. The 64
bits are cut into ``segments`` equal parts; the population counts of the parts name a cell, and if two
fingerprints differ in at most r bits, the summed differences of their population counts are at most r. So
a tile (a cell, or a part of a crowded cell) is compared, by exclusive-or and bit counts in numpy, only
with rows from cells within that distance; all other tile pairs are skipped. Copies sent per fingerprint
depend on ``segments`` and ``radius`` alone, and more segments make the cells finer: 4 suit some ten million
distinct fingerprints, 8 some billions, 16 more. ``segments=None`` picks by the count; every choice gives
the same result. Each tile returns a spanning forest of its links, not the links.

Defined cases: null text counts as empty; a text without words has fingerprint 0 and links like any other;
fewer words than a shingle give one shingle; a null id gets the component of its fingerprint, but a
fingerprint that only null ids have makes no links (component null); repeated rows are all reported; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, shared_table, small_batches, without_ids
from ._graph import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit; where there are many, each byte's values are counted first."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 400:
        return np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    counts = sum(np.bincount((octets[k : k + 65536] + np.arange(0, 2048, 256)).ravel(), minlength=2048) for k in range(0, len(octets), 65536))
    return (counts.reshape(8, 256) @ _BITS).ravel()


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one UTF-8 text, as an unsigned integer."""
    tokens = text.translate(_LOWER).split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(tokens), seed)], np.uint64)
    else:
        joined = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(tokens) - words + 1
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())), np.uint64, n)
    return int(np.packbits(bit_sums(h) * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed 64-bit integer."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fp = np.fromiter((fingerprint(t or b"", words, seed) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _forest(a: np.ndarray, b: np.ndarray, n: int, label: np.ndarray) -> np.ndarray:
    """Labels (smallest index reachable) after adding the links a-b to those that ``label`` already stands for."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, after := label[label]):
            label = after


def _compare(radius: int, step: int = 1 << 18):
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        here = tile["home"].to_numpy()
        fp, node = tile["fp"].to_numpy().view(np.uint64), tile["node"].to_numpy()
        home, guest = np.flatnonzero(here), np.flatnonzero(~here)
        label = np.arange(len(tile))
        width, own = max(1, step // max(1, len(home))), fp[home][:, None]
        for k in range(0, len(guest), width):
            part = guest[k : k + width]
            close = np.bitwise_count(own ^ fp[part][None, :]) <= radius
            if close.any():
                close &= label[home][:, None] != label[part][None, :]  # in a dense tile few links are new
                i, j = np.nonzero(close)
                label = _forest(home[i], part[j], len(tile), label)
        moved = np.flatnonzero(label != np.arange(len(tile)))
        out = pd.DataFrame({"a": node[moved], "b": node[label[moved]]})
        return out[out["a"] != out["b"]]

    return run


def links(reps: DataFrame, radius: int = 2, segments: int | None = None, tile_rows: int = 8192) -> DataFrame:
    """A spanning forest (a, b) of the links between the rows of ``reps`` (node, fp), whose fp are distinct."""
    spark = reps.sparkSession
    if segments is None:
        n = reps.count()
        segments = 4 if n <= 20_000_000 else 8 if n <= 2_000_000_000 else 16
    width = 64 // segments
    base = width + 1 + 2 * radius  # counts shifted by the radius never borrow
    bits = (1 << width) - 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit(bits))) for i in range(segments)]
    cell = sum((c.cast("long") * F.lit(base**i) for i, c in enumerate(counts)), F.lit(0).cast("long"))
    steps = [d for d in _steps(segments, radius) if d >= (0,) * segments]  # of a pair of cells, one visits the other
    moves = F.array(*[F.lit(sum(x * base**i for i, x in enumerate(reversed(d)))).cast("long") for d in steps])
    cells = reps.select("node", "fp", cell.alias("cell"))
    # tiles: at most tile_rows rows at home, about four times as many guests
    size = cells.groupBy("cell").agg(F.count("*").alias("h"))
    guests = size.select(F.explode(F.transform(moves, lambda m: F.col("cell") + m)).alias("cell"), F.col("h").alias("g")).groupBy("cell").agg(F.sum("g").alias("g"))
    plan = size.join(guests, "cell").select("cell", F.ceil(F.col("h") / tile_rows).cast("int").alias("k"), F.ceil((F.col("h") + F.col("g")) / (4 * tile_rows)).cast("int").alias("m"))
    plan = shared_table(plan, "tiles")
    pick = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    home = cells.join(plan, "cell").select("cell", pick("k").alias("i"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"), "node", "fp", F.lit(True).alias("home"))
    guest = cells.select("node", "fp", F.explode(F.transform(moves, lambda m: F.col("cell") + m)).alias("cell"))
    guest = guest.join(plan, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"), pick("m").alias("j"), "node", "fp", F.lit(False).alias("home"))
    # each (cell, i, j) holds its guests with their own row at home among them: a pair meets in one tile
    return home.unionByName(guest).groupBy("cell", "i", "j").applyInPandas(_compare(radius), "a long, b long")


def _steps(segments: int, radius: int) -> Iterator[tuple[int, ...]]:
    """All integer vectors of the given length whose absolute values sum to the radius at most."""
    if segments == 0:
        yield ()
        return
    for x in range(-radius, radius + 1):
        for rest in _steps(segments - 1, radius - abs(x)):
            yield (x, *rest)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, seed: int = 42, segments: int | None = None, tile_rows: int = 8192) -> DataFrame:
    """One row per row of ``docs``: id, fp (signed), component_id."""
    fps = shared_table(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    reps = shared_table(fps.groupBy("fp").agg(F.min("id").alias("node")), "representatives")
    edges = links(reps.where("node is not null"), radius, segments, tile_rows)
    labels = components(edges)
    comp = reps.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    comp = shared_table(comp, "components")
    discard(reps)
    return fps.join(comp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id. Rows with a null id stay."""
    groups = near_groups(docs, id_col, text_col, **kw)
    gone = shared_table(groups.where(F.col(id_col) != F.col("component_id")).select(id_col), "near-copies")
    return without_ids(docs, gone, id_col)
