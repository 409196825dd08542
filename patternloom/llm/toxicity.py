"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade <= k | x) = sigmoid(threshold_k - w . x): one weight vector, shared by all thresholds, which are kept
in order (each is the one before plus an exponential). The output is the expected severity, the sum over
k of P(grade > k).

Features: a text's distinct words (lower-cased runs of letters and digits), each with its first three to five
characters, hashed to ``2**bits`` columns; values are 0 and 1. Only columns that mark grades above the lowest
in the training rows have weights, so most words have none, and scoring looks each distinct word up once.

Fitting: AdaGrad on the regularised likelihood over at most ``train_rows`` labelled rows and ``train_bytes`` of text,
picked by hash of the id, on the driver; whole texts. Rows over the lowest grade are up to half of them, however rare they are. Copies and near copies among them count once: of rows that share
one of three MinHash values over five-word shingles only the first is used. The model, ``2**bits`` floats, is sent to the executors; texts
are not shuffled.

Grades may be given as a column. Where labels only say toxic or not, :func:`grade_by_marks` splits the
toxic rows in two grades at the median number of distinct words that mark them.

Defined cases: null text counts as empty and gets the severity of a text without features; null ids and
repeated rows are scored like any other; labels that are null are left out; without labels of two grades,
or without a feature that marks the higher ones, severity is that of the lowest grade; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, Rolling, WordHash, discard, mixed, shared_table, small_batches

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def columns_of(word: str, mask: int) -> list[int]:
    parts = [f"={word}", *(f"^{word[:k]}" for k in (3, 4, 5) if len(word) >= k)]
    return [xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass")) & mask for p in parts]


@dataclass(frozen=True)
class OrdinalModel:
    bits: int
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, margin: np.ndarray) -> np.ndarray:
        """Expected grade at a margin w . x."""
        return (1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margin[:, None], -60, 60)))).sum(axis=1)


class Marks(dict):
    """Word to those of its columns that have a weight."""

    def __init__(self, weights: np.ndarray, mask: int):
        super().__init__()
        self.weights, self.mask = weights, mask

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 400_000:
            self.clear()
        x = self[word] = tuple(c for c in columns_of(word, self.mask) if self.weights[c])
        return x

    def margin(self, text: str | None) -> float:
        found = {c for columns in filter(None, map(self.__getitem__, words_of(text))) for c in columns}
        return float(sum(self.weights[c] for c in sorted(found)))


def _matrix(texts: list[str | None], marked: np.ndarray, bits: int, least_rows: int, least_share: float, doubt: float):
    """Rows and columns of the training texts, of the columns that mark rows over grade 0: in ``least_rows`` rows or more, of
    which ``least_share`` or more are marked, which by chance alone (Chernoff's bound) about e**``doubt`` of all such
    columns would be. So the bound rises with the number of columns looked at, and what it takes of rows falls
    with the share of marked rows: tables with few labels keep their clearest marks."""
    mask, cache = (1 << bits) - 1, {}
    cols = []
    seen, hits = np.zeros(1 << bits), np.zeros(1 << bits)
    for text, hit in zip(texts, marked):
        flat: list[int] = []
        for w in words_of(text):
            if w not in cache:
                if len(cache) > 400_000:
                    cache.clear()
                cache[w] = columns_of(w, mask)
            flat += cache[w]
        c = np.unique(np.array(flat, np.int32))
        seen[c] += 1
        hits[c] += hit
        cols.append(c)
    share = np.clip(marked.mean(), 1e-9, 1 - 1e-9)
    own = np.clip(hits / np.maximum(seen, 1), 1e-9, 1 - 1e-9)
    chance = seen * (own * np.log(own / share) + (1 - own) * np.log((1 - own) / (1 - share)))
    enough = seen >= least_rows
    use = enough & (own >= max(least_share, share)) & (chance >= np.log(max(2, enough.sum())) - doubt)
    rows = np.repeat(np.arange(len(texts)), [len(c) for c in cols])
    cols = np.concatenate(cols)
    on = use[cols]
    return rows[on], cols[on].astype(np.int64)


def distinct_rows(texts: list[str | None], k: int = 5) -> list[int]:
    """Numbers of the rows that are no copy or near copy of an earlier one, as far as MinHash tells."""
    hashes, taken, out = WordHash(), set(), []
    for i, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if words:
            roll = Rolling(hashes.array(words))
            h = roll.of(np.arange(max(1, len(words) - k + 1)), min(k, len(words)))
            keys = [(j, int(mixed(h + np.uint64(j)).min())) for j in range(3)]
        else:
            keys = [(0, -1)]
        if taken.isdisjoint(keys):
            out.append(i)
        taken.update(keys)
    return out


def thresholds_of(t: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first as it is, each other the one before plus an exponential."""
    return np.cumsum(np.concatenate(([t[0]], np.exp(t[1:]))))


def likelihood(x: np.ndarray, t: np.ndarray, rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, heft: np.ndarray, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of the grades, weighted by ``heft``, plus ``l2`` / 2 |x|**2, and its gradients by the weights
    ``x`` and the thresholds' parameters ``t``. The features that are 1 are given by ``rows`` and ``cols``."""
    n, top = len(grades), len(t)
    margin = np.bincount(rows, x[cols], n)
    cdf = 1 / (1 + np.exp(-np.clip(np.concatenate(([-np.inf], thresholds_of(t), [np.inf]))[None, :] - margin[:, None], -60, 60)))
    cdf[:, 0], cdf[:, -1] = 0.0, 1.0
    i = np.arange(n)
    low, high = cdf[i, grades], cdf[i, grades + 1]
    p = np.maximum(high - low, 1e-12)
    slope_high, slope_low = high * (1 - high), low * (1 - low)
    g_margin = (slope_high - slope_low) / p * heft
    g_theta = np.zeros(top + 2)
    np.add.at(g_theta, grades + 1, -slope_high / p * heft)
    np.add.at(g_theta, grades, slope_low / p * heft)
    back = np.cumsum(g_theta[1:-1][::-1])[::-1]
    g_t = np.concatenate(([back[0]], back[1:] * np.exp(t[1:])))
    g_x = np.bincount(cols, g_margin[rows], len(x)) + l2 * x
    return float(-(heft * np.log(p)).sum() + l2 / 2 * (x**2).sum()), g_x, g_t


def fit_ordinal(texts: list[str | None], grades: np.ndarray, bits: int = 20, least_rows: int = 3, least_share: float = 0.8, doubt: float = 2.0, l2: float = 1e-6, steps: int = 400, rate: float = 0.5, lift: float = 8.0) -> OrdinalModel:
    """Full-gradient AdaGrad on the mean negative log-likelihood plus ``l2`` / 2 |w|**2; rows over grade 0 count
    ``lift`` times."""
    top = int(grades.max()) if len(grades) else 0
    w = np.zeros(1 << bits)
    if top == 0 or len(np.unique(grades)) < 2:
        return OrdinalModel(bits, w, np.full(max(top, 1), 60.0))
    first = distinct_rows(texts)
    texts, grades = [texts[i] for i in first], grades[first]
    rows, cols = _matrix(texts, grades > 0, bits, least_rows, least_share, doubt)
    used, cols = np.unique(cols, return_inverse=True)
    if not len(used):  # nothing tells the grades apart
        return OrdinalModel(bits, w, np.full(top, 60.0))
    n, d = len(texts), len(used)
    x, sum_x = np.zeros(d), np.full(d, 1e-8)
    share = np.clip([(grades <= k).mean() for k in range(top)], 1e-3, 1 - 1e-3)
    raw = np.log(share / (1 - share))
    t = np.concatenate(([raw[0]], np.log(np.maximum(np.diff(raw), 0.1))))
    sum_t = np.full(top, 1e-8)
    heft = np.where(grades > 0, lift, 1.0)
    heft /= heft.sum()
    for _ in range(steps):
        _, g_x, g_t = likelihood(x, t, rows, cols, grades, heft, l2)
        sum_x += g_x**2
        sum_t += g_t**2
        x -= rate * g_x / np.sqrt(sum_x)
        t -= rate * g_t / np.sqrt(sum_t)
    w[used] = x
    return OrdinalModel(bits, w, thresholds_of(t))


def grade_by_marks(texts: list[str | None], toxic: np.ndarray) -> np.ndarray:
    """Grade 0: not toxic; 1 and 2: toxic, below and from the median number of distinct words that mark
    toxic rows (met mostly in toxic rows: log odds over 2)."""
    yes, no = {}, {}
    sets = [words_of(t) for t in texts]
    for s, flag in zip(sets, toxic):
        count = yes if flag else no
        for w in s:
            count[w] = count.get(w, 0) + 1
    n_yes, n_no = max(1, int(toxic.sum())), max(1, int((toxic == 0).sum()))
    marks = {w for w, c in yes.items() if c >= 3 and np.log((c + 0.5) / n_yes) - np.log((no.get(w, 0) + 0.5) / n_no) > 2}
    found = np.array([len(s & marks) for s in sets])
    if not toxic.any():
        return np.zeros(len(texts), np.int64)
    return np.where(toxic == 0, 0, np.where(found < np.median(found[toxic == 1]), 1, 2)).astype(np.int64)


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, train_rows: int, usable=None, rare: int | None = None, train_bytes: int = 128 << 20) -> tuple[list, np.ndarray]:
    """Texts and labels of ``train_rows`` labelled ids at most, in the order of a hash of the id, and of no more than
    ``train_bytes`` of text. ``rare``: half of the rows are kept for labels of that value or more, or as many as there are.

    An id counts once, with its smallest label and one of its texts, however often it occurs. Ids are drawn first, at a rate that
    gives about ``train_rows``; their texts are then staged, and what fits the bounds, by the ids' hashes, is read."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = (known if usable is None else known.where(usable)).groupBy(F.col(id_col).alias("lid")).agg(F.min(label_col).cast("int").alias("label"))
    is_rare = F.col("label") >= (2**31 - 1 if rare is None else rare)
    n = dict(known.groupBy(is_rare.alias("rare")).count().collect())
    most = train_rows // 2
    rate = F.when(is_rare, min(1.0, most / max(1, n.get(True, 0)))).otherwise(min(1.0, (train_rows - min(most, n.get(True, 0))) / max(1, n.get(False, 0))))
    some = known.withColumn("draw", F.xxhash64(F.lit("train"), "lid")).where(F.pmod("draw", F.lit(1_000_003)) / 1_000_003 < rate)
    some = F.broadcast(some) if train_rows <= BROADCAST_ROWS else some
    texts = docs.select(F.col(id_col).alias("did"), F.col(text_col).alias("text"))
    got = texts.join(some, F.col("did") == F.col("lid")).groupBy("lid", "label", "draw").agg(F.min("text").alias("text"))
    staged = got = shared_table(got.withColumn("turn", F.when(is_rare, 0).otherwise(1)), "training")
    size = got.select("turn", "draw", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).toArrow().sort_by([("turn", "ascending"), ("draw", "ascending")])
    fits = (np.cumsum(size["n"].to_numpy().astype(np.int64)) <= train_bytes) & (np.arange(size.num_rows) < train_rows)
    if not fits.all():
        turn, draw = (int(size[c][int(np.argmin(fits))].as_py()) for c in ("turn", "draw"))
        got = got.where((F.col("turn") < turn) | (F.col("turn") == turn) & (F.col("draw") < draw))
    rows = got.select("lid", "text", "label").toArrow().sort_by("lid")
    discard(staged)
    return rows["text"].to_pylist(), rows["label"].to_numpy()


def score_severity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity, grade): severity from 0 to the highest grade, grade the nearest one."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.bits, model.weights, model.thresholds))  # 2**bits weights; plain values need no package to be read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = OrdinalModel(*held.value)
        marks = Marks(m.weights, (1 << m.bits) - 1)
        for b in batches:
            margin = np.array([marks.margin(t) for t in b.column(1).to_pylist()], np.float64)
            s = m.severity(margin)
            yield pa.record_batch([b.column(0), pa.array(s), pa.array(np.rint(s).astype(np.int32))], names=["id", "severity", "grade"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, severity double, grade int").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str | None = None, toxic_col: str = "toxic", train_rows: int = 12_000, **kw) -> DataFrame:
    """Fit on labelled rows of ``docs`` and score all of them: (id, severity, grade)."""
    texts, marks = training_rows(docs, labels, grade_col or toxic_col, id_col, text_col, train_rows, rare=1)
    grades = marks.astype(np.int64) if grade_col else grade_by_marks(texts, marks.astype(np.int64))
    return score_severity(docs, fit_ordinal(texts, grades, **kw), id_col, text_col)
