"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams (one and two in a row) over two token streams of a text: the tokens
themselves (runs of letters, digits or other signs, lower-cased) and their shapes (case pattern and length
class of a word, the sign itself, "same as the token before"). They are hashed to ``2**bits`` columns. Each
column is scaled by its class log-count ratio, each row to unit length, and a linear model with hinge loss is
fitted by dual coordinate descent (L2-regularised, L1 loss; bias as a constant feature). A logistic curve
fitted to the margins of training rows left out of the fit gives scores from 0 to 1.

Fitting uses at most about ``train_rows`` labelled rows, picked by hash of the id, on the driver; whole texts.
Scoring is one pass over the documents with the ``2**bits`` weights; texts are not shuffled.

Defined cases: null text counts as empty; empty texts are scored (by the bias); null ids and repeated rows are
scored like any other; null labels are left out; without rows of both classes every score is the share of
label 1 (0.5 without rows); an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mixed, small_batches
from .toxicity import training_rows

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _shape(token: str) -> str:
    if token[0].isalpha():
        case = "u" if token.isupper() and len(token) > 1 else "c" if token[0].isupper() else "l"
        return case + str(min(len(token).bit_length(), 5))
    return "9" if token[0].isdigit() else token[:4]


class Tokens(dict):
    """Token to a pair of hashes: of itself, lower-cased, and of its shape."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= 400_000:
            self.clear()
        h = lambda s: xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))
        x = self[token] = (h("t" + token.lower()), h("s" + _shape(token)))
        return x


def columns_of(text: str | None, tokens: Tokens, bits: int) -> np.ndarray:
    """Sorted distinct columns of the text's n-grams."""
    found = _TOKEN.findall(text) if text else []
    if not found:
        return np.zeros(0, np.int64)
    h = np.fromiter(chain.from_iterable(map(tokens.__getitem__, found)), np.uint64, 2 * len(found)).reshape(-1, 2)
    word, shape = h[:, 0], h[:, 1]
    shape = shape.copy()
    shape[1:][word[1:] == word[:-1]] = 1  # same as before
    grams = [word, shape]
    for stream in (word, shape):
        grams.append(mixed(stream[:-1] * _MIX + stream[1:]))
    return np.unique((np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64))


@dataclass(frozen=True)
class QualityModel:
    bits: int
    ratio: np.ndarray  # class log-count ratios
    weights: np.ndarray  # of the scaled columns, times the ratio
    bias: float
    slope: float
    shift: float

    def margin(self, columns: np.ndarray) -> float:
        r = self.ratio[columns]
        size = float(np.sqrt((r * r).sum())) or 1.0
        return float(self.weights[columns].sum()) / size + self.bias

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60)))


def dual_descent(ptr: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, d: int, cost: np.ndarray, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """min |w|**2 / 2 + sum cost_i max(0, 1 - y_i (w . x_i + b)) by coordinate descent on the dual."""
    w, bias, alpha = np.zeros(d), 0.0, np.zeros(len(y))
    norms = np.array([float((vals[a:b] ** 2).sum()) for a, b in zip(ptr[:-1], ptr[1:])]) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            c, v = cols[ptr[i] : ptr[i + 1]], vals[ptr[i] : ptr[i + 1]]
            slope = y[i] * (w[c] @ v + bias) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[c] += step * y[i] * v
                bias += step * y[i]
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(y = 1 | margin), by Newton's method with a little shrinkage."""
    a, b = 2.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - y) * m).sum() + 1e-2 * (a - 2.0), (p - y).sum() + 1e-3 * b])
        s = p * (1 - p)
        h = np.array([[(s * m * m).sum() + 1e-2, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def fit_quality(texts: list[str | None], labels: np.ndarray, bits: int = 18, smooth: float = 1.0, cost: float = 1.0, epochs: int = 12) -> QualityModel:
    size = 1 << bits
    y = np.where(labels == 1, 1.0, -1.0)
    if len(np.unique(y)) < 2:
        share = float(np.clip((labels == 1).mean(), 1e-6, 1 - 1e-6)) if len(labels) else 0.5
        return QualityModel(bits, np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))))
    tokens = Tokens()
    rows = [columns_of(t, tokens, bits) for t in texts]
    fit = np.arange(len(y)) % 5 != 4  # every fifth row is for the curve
    if len(np.unique(y[fit])) < 2 or len(np.unique(y[~fit])) < 2:
        fit[:] = True
    counts = {s: np.full(size, smooth) for s in (1.0, -1.0)}
    for r, s, f in zip(rows, y, fit):
        if f:
            counts[s][r] += 1
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    kept = [rows[i] for i in np.flatnonzero(fit)]
    ptr = np.concatenate(([0], np.cumsum([len(r) for r in kept])))
    cols = np.concatenate(kept)
    vals = ratio[cols]
    norm = np.sqrt(np.array([(vals[a:b] ** 2).sum() for a, b in zip(ptr[:-1], ptr[1:])]))
    vals = vals / np.repeat(np.where(norm > 0, norm, 1.0), np.diff(ptr))
    part = {s: (y[fit] == s).mean() for s in (1.0, -1.0)}
    w, bias = dual_descent(ptr, cols, vals, y[fit], size, np.array([cost / (2 * part[s]) for s in y[fit]]), epochs)
    model = QualityModel(bits, ratio, w * ratio, float(bias), 1.0, 0.0)
    held = ~fit if not fit.all() else fit
    margins = np.array([model.margin(rows[i]) for i in np.flatnonzero(held)])
    return QualityModel(bits, ratio, w * ratio, float(bias), *_logistic(margins, (labels[held] == 1).astype(float)))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row."""
    small_batches(docs.sparkSession)
    parts = (model.bits, model.ratio, model.weights, model.bias, model.slope, model.shift)  # plain values need no package to be read
    held = docs.sparkSession.sparkContext.broadcast(parts)  # 2**bits weights and ratios

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, tokens = QualityModel(*held.value), Tokens()
        for b in batches:
            margins = np.array([m.margin(columns_of(t, tokens, m.bits)) for t in b.column(1).to_pylist()], np.float64)
            yield pa.record_batch([b.column(0), pa.array(m.score(margins))], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = 8_000, usable=None, **kw) -> DataFrame:
    """Fit on labelled rows of ``docs`` (only those where ``usable`` holds) and score all of them: (id, score)."""
    texts, y = training_rows(docs, labels, label_col, id_col, text_col, train_rows, usable)
    return score_quality(docs, fit_quality(texts, y, **kw), id_col, text_col)
