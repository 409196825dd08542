"""Language identification by Bayesian evidence fusion.

The posterior of a row's language is proportional to

    prior(host) x P(declared markup language | language) x P(text | language) ** 1/3

* Text: hashed byte trigrams (2**16 buckets, add-one-half smoothing); the exponent allows for each byte
  standing in three trigrams. The tables are fitted on a sample of labelled rows of about
  ``rows_per_language`` a language, which bounds nothing but the fit.
* Host prior: sums of the text posteriors over all rows, grouped by host and smoothed along the hierarchy
  global, address suffix, site (last two labels), host, each level with ``weight`` rows' worth of its parent. A host
  of one label, such as the name of a source, has the levels global and host only.
* Declared language: how often each declared value goes with each language, from the same sums over all
  rows, smoothed towards "says nothing".

Sums are taken without the row that they are used for, so no row's text counts twice.

A further class "und" has uniform trigrams and a small prior; text that no language explains better than
that, text without letters, and posteriors under ``least`` are rejected.

Sums are partial aggregations of narrow rows; the scored rows are written once to the shared folder; texts
are not shuffled.

Defined cases: null text is empty, has language null and is rejected; null or missing host and declared
language leave those factors out (global prior); null ids and repeated rows are reported like any other;
an empty table gives no rows; without a single labelled row there is no language to find, all text is "und" and is
rejected by :func:`identify`, while :func:`keep_identified` keeps all rows; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import shared_table, small_batches, without_ids

BUCKETS = 1 << 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def trigrams(text: bytes) -> np.ndarray:
    """Bucket of each byte trigram of the text, A-Z lower-cased, with a blank at either end."""
    b = np.frombuffer(b" " + text.translate(_LOWER) + b" ", np.uint8).astype(np.uint32)
    return (((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    """log P(bucket | language), the last row being "und"."""

    languages: tuple[str, ...]
    table: np.ndarray


def fit_text_model(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 2000) -> TextModel:
    """Counts over about ``rows_per_language`` rows of each label (rows picked by hash of the id)."""
    small_batches(labelled.sparkSession)
    counts = {r[0]: r[1] for r in labelled.where(F.col(lang_col).isNotNull()).groupBy(lang_col).count().collect()}
    languages = tuple(sorted(counts))
    rate = reduce(lambda c, k: c.when(F.col(lang_col) == k, min(1.0, rows_per_language / counts[k])), languages, F.when(F.lit(False), 0.0))
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col)), F.lit(1_000_003)) / 1_000_003
    index = reduce(lambda c, k: c.when(F.col(lang_col) == k[1], k[0]), enumerate(languages), F.when(F.lit(False), -1))
    sample = labelled.where(draw < rate).select(index.alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if text:
                    total[lang * BUCKETS : (lang + 1) * BUCKETS] += np.bincount(trigrams(text), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    sums = sample.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(len(languages) * BUCKETS)
    table[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    table = table.reshape(len(languages), BUCKETS) + 0.5
    table = np.log(table / table.sum(axis=1, keepdims=True))
    return TextModel(languages, np.vstack([table, np.full((1, BUCKETS), -np.log(BUCKETS))]).astype(np.float32))


def _start(size: int, unknown: float) -> np.ndarray:
    """Log prior of the languages and "und" before any host is known."""
    return np.log([*[(1 - unknown) / max(1, size - 1)] * (size - 1), unknown])


def _text_evidence(rows: DataFrame, model: TextModel, start: np.ndarray) -> DataFrame:
    """``rows`` (id, host, declared, text) with ``e``: log P(text | language) / 3 less the largest, and ``own``: the
    posterior by the text alone; both null without letters."""
    table = np.ascontiguousarray(model.table.T)
    held = rows.sparkSession.sparkContext.broadcast(table)  # 2**16 times the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float64())
        for b in batches:
            evidence, posterior = [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                if not text or not _LETTER[np.frombuffer(text, np.uint8)].any():
                    evidence.append(None)
                    posterior.append(None)
                    continue
                grams = trigrams(text)
                e = sum(held.value[grams[k : k + 65536]].sum(axis=0, dtype=np.float64) for k in range(0, len(grams), 65536)) / 3
                e = e - e.max()
                p = np.exp(np.maximum(e + start - (e + start).max(), -700))
                evidence.append(e.tolist())
                posterior.append((p / p.sum()).tolist())
            yield pa.record_batch([b.column("id"), b.column("host"), b.column("declared"), pa.array(evidence, kind), pa.array(posterior, kind)], names=["id", "host", "declared", "e", "own"])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, "id long, host string, declared string, e array<double>, own array<double>")


def _dense(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a column of lists of ``size`` numbers; zeros for null."""
    out = np.zeros((len(column), size))
    out[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    return out


def _fused(total: np.ndarray, names: list[str], weight: float, least: float):
    """Posteriors from a row's evidence and the sums of its host's levels and declared language, each without the row."""
    size = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, own = _dense(b.column("e"), size), _dense(b.column("own"), size)
            letters = b.column("e").is_valid().to_numpy(zero_copy_only=False)
            others = np.maximum(total - own, 0)
            prior = (others + 1 / size) / (np.maximum(total.sum() - letters, 0) + 1)[:, None]
            for level in ("suffix_sums", "site_sums", "sums"):
                known = b.column(level).is_valid().to_numpy(zero_copy_only=False)
                rest = np.maximum(_dense(b.column(level), size) - own, 0)
                narrow = (rest + weight * prior) / (rest.sum(axis=1, keepdims=True) + weight)
                prior = np.where(known[:, None], narrow, prior)
            said = np.maximum(_dense(b.column("said"), size) - own, 0)
            said[said.sum(axis=1) < 1e-9] = 0
            share = said.sum(axis=1, keepdims=True) / np.maximum(others.sum(axis=1, keepdims=True), 1e-9)
            word = np.where(share > 0, np.log(np.maximum(said + weight * share, 1e-300) / (others + weight)), 0)
            logs = np.log(prior) + word + e
            post = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -700))
            post /= post.sum(axis=1, keepdims=True)
            best = post.argmax(axis=1)
            sure = post[np.arange(len(post)), best]
            ok = letters & (best < size - 1) & (sure >= least)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, post.size + 1, size, dtype=np.int32)), pa.array(post.ravel()))
            lang = pa.array([names[k] if x else None for k, x in zip(best.tolist(), letters.tolist())], pa.string())
            yield pa.record_batch([b.column("id"), lang, pa.array(sure, mask=~letters), pa.array(ok), flat], names=["id", "lang", "probability", "accepted", "post"])

    return run


def _host_sums(hosts: DataFrame, size: int) -> DataFrame:
    """h, and the sums of the host's address suffix (suffix_sums), site (site_sums) and of itself (sums)."""
    label = F.split("host", r"\.")
    many = F.size(label) > 1
    tree = hosts.withColumns({"suffix": F.when(many, F.element_at(label, -1)), "site": F.when(many, F.array_join(F.slice(label, -2, 2), "."))})
    for level in ("suffix", "site"):
        total = F.array(*[F.sum(F.col("sums")[i]) for i in range(size)])
        own = tree.where(F.col(level).isNotNull()).groupBy(F.col(level).alias("k")).agg(total.alias(f"{level}_sums"))
        tree = tree.join(own, F.col(level) == F.col("k"), "left").drop("k")
    return tree.select(F.col("host").alias("h"), "suffix_sums", "site_sums", "sums")


def identify(rows: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = None, declared_col: str | None = None, weight: float = 20.0, least: float = 0.5, unknown: float = 1e-3) -> DataFrame:
    """id, lang, probability, accepted, and the languages' posteriors as a map, for every row."""
    none = F.lit(None).cast("string")
    rows = rows.select(
        F.col(id_col).cast("long").alias("id"),
        (F.lower(F.col(host_col)) if host_col else none).alias("host"),
        (F.lower(F.regexp_extract(F.col(declared_col), "^[A-Za-z]+", 0)) if declared_col else none).alias("declared"),
        F.col(text_col).alias("text"),
    )
    names = [*model.languages, "und"]
    size = len(names)
    scored = shared_table(_text_evidence(rows, model, _start(size, unknown)), "text-evidence")
    sums = F.array(*[F.sum(F.col("own")[i]) for i in range(size)]).alias("sums")
    lettered = scored.where("own is not null")
    hosts = shared_table(lettered.where("host is not null").groupBy("host").agg(sums), "hosts")
    said = shared_table(lettered.groupBy("declared").agg(sums), "declared")
    whole = said.agg(*[F.sum(F.col("sums")[i]) for i in range(size)]).first()
    total = np.array([float(x or 0.0) for x in whole])
    tree = shared_table(_host_sums(hosts, size), "host-sums")
    spoken = said.where("declared <> ''").select(F.col("declared").alias("d"), F.col("sums").alias("said"))
    rows = scored.join(tree, F.col("host") == F.col("h"), "left").join(spoken, F.col("declared") == F.col("d"), "left")
    rows = rows.select("id", "e", "own", "suffix_sums", "site_sums", "sums", "said")
    out = rows.mapInArrow(_fused(total, names, weight, least), "id long, lang string, probability double, accepted boolean, post array<double>")
    posterior = F.map_from_arrays(F.array(*[F.lit(k) for k in names]), "post")
    return out.select(F.col("id").alias(id_col), "lang", "probability", "accepted", posterior.alias("posterior"))


def host_of(url: Column) -> Column:
    """Host of a URL, without user and port."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def visible_text(html: Column) -> Column:
    """Text of a page: without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&[a-zA-Z#0-9]+;", " ")


def declared_language(html: Column) -> Column:
    """Value of the lang attribute of the page's html element; null without one."""
    return F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1), F.lit(""))


def keep_identified(docs: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", wanted: tuple[str, ...] | None = None, **kw) -> DataFrame:
    """``docs`` without those that are rejected or in a language not ``wanted`` (None: any). Rows with a null id stay, and
    all rows where the model knows no language. Of rows that share an id one rejected is enough for all to go."""
    if not model.languages:
        return docs
    found = identify(docs, model, id_col, text_col, host_col, **kw)
    ok = F.col("accepted") & (F.col("lang").isin(*wanted) if wanted else F.lit(True))
    gone = shared_table(found.where(~ok & F.col(id_col).isNotNull()).select(id_col), "rejected")
    return without_ids(docs, gone, id_col)
