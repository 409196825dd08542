"""Correlations between the most frequent patterns: pattern_a, pattern_b, correlation_type, description, strength."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.severity import mentions_error
from ..sources.staging import stage
from .stats import minute_span

CANDIDATES = 20


def candidates(patterns: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """pattern_id, template, rank (from 1) of the n most frequent patterns."""
    top = patterns.select("pattern_id", "template", "count").orderBy(F.desc("count"), "pattern_id").limit(n)
    return top.select("pattern_id", "template", F.row_number().over(Window.orderBy(F.desc("count"), "pattern_id")).alias("rank"))


def pearson(n: Column, a: Column, b: Column, aa: Column, bb: Column, ab: Column) -> Column:
    """Pearson's r of n pairs from their sums; 0 for fewer than two pairs or where either hardly varies."""
    n, a, b, aa, bb, ab = (x.cast("double") for x in (n, a, b, aa, bb, ab))
    spread = F.sqrt(F.greatest(n * aa - a * a, F.lit(0.0))) * F.sqrt(F.greatest(n * bb - b * b, F.lit(0.0)))  # n squared times that of the two deviations
    return F.coalesce(F.when((n >= 2) & (spread / n >= 1e-10), F.try_divide(n * ab - a * b, spread)), F.lit(0.0))


def _lagged(buckets: DataFrame, chosen: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """pattern_a, rank_a, template_a, the same of b, lag, len and r: Pearson's r of a's counts in the minutes that have
    one ``lag`` minutes later, and b's counts there. For all pairs of ``chosen``, few as they are; sums run over the minutes with
    lines only, and the others count by the span's length."""
    span = F.broadcast(minute_span(buckets))
    lag = F.explode(F.array(*[F.lit(x) for x in lags])).alias("lag")
    who = lambda s: chosen.select(*[F.col(c).alias(f"{n}_{s}") for c, n in (("pattern_id", "pattern"), ("rank", "rank"), ("template", "template"))])
    rows = buckets.join(F.broadcast(chosen.select("pattern_id")), "pattern_id").join(span)
    rows = rows.select("pattern_id", F.col("n").cast("double").alias("n"), (F.col("minute") - F.col("first")).alias("at"), "len", lag)
    rows = stage(rows, "minutes")  # at most as many rows as the chosen patterns have minutes, for each lag
    part = lambda s, inside: rows.where(inside).groupBy(F.col("pattern_id").alias(f"pattern_{s}"), "lag").agg(F.sum("n").alias(s), F.sum(F.col("n") * F.col("n")).alias(s + s))
    a, b = part("a", F.col("at") + F.col("lag") < F.col("len")), part("b", F.col("at") >= F.col("lag"))
    x = rows.select(F.col("pattern_id").alias("pattern_a"), "lag", (F.col("at") + F.col("lag")).alias("at"), F.col("n").alias("x"))
    y = rows.select(F.col("pattern_id").alias("pattern_b"), "lag", "at", F.col("n").alias("y"))
    ab = x.join(y, ["lag", "at"]).groupBy("pattern_a", "pattern_b", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("ab"))
    pairs = who("a").join(F.broadcast(who("b")), F.col("rank_a") != F.col("rank_b")).select("*", lag).join(span)
    pairs = pairs.join(a, ["pattern_a", "lag"], "left").join(b, ["pattern_b", "lag"], "left").join(ab, ["pattern_a", "pattern_b", "lag"], "left").fillna(0.0, ["a", "b", "aa", "bb", "ab"])
    r = pearson(F.col("len") - F.col("lag"), *[F.col(c) for c in ("a", "b", "aa", "bb", "ab")])
    return pairs.withColumn("r", r)


def temporal(buckets: DataFrame, chosen: DataFrame, least: float = 0.7) -> DataFrame:
    """Pairs whose minute counts go together; at least three minutes."""
    found = _lagged(buckets, chosen, (0,)).where((F.col("rank_a") < F.col("rank_b")) & (F.col("len") >= 3) & (F.abs("r") > least))
    return found.select("pattern_a", "pattern_b", F.lit("TemporalCooccurrence").alias("correlation_type"), F.format_string("spike together (r=%.2f)", "r").alias("description"), F.abs("r").alias("strength"), "rank_a", "rank_b")


def shared_variables(slots: DataFrame, tops: DataFrame, chosen: DataFrame, share: float = 0.5) -> DataFrame:
    """Pairs with a slot each of one type whose ten most frequent values overlap by more than ``share`` of the smaller
    set; of several slot pairs the first."""
    keyed = tops.where("rank <= 10").join(slots.select("pattern_id", "slot", "var_type"), ["pattern_id", "slot"]).join(F.broadcast(chosen.select("pattern_id", F.col("rank").alias("place"))), "pattern_id")
    sizes = keyed.groupBy("pattern_id", "slot").agg(F.count("*").alias("size"))
    keyed = keyed.join(sizes, ["pattern_id", "slot"])
    side = lambda s: keyed.select("var_type", "value", *[F.col(c).alias(f"{n}_{s}") for c, n in (("pattern_id", "pattern"), ("slot", "slot"), ("size", "size"), ("place", "rank"))])
    both = side("a").join(side("b"), ["var_type", "value"]).where("rank_a < rank_b")
    hits = both.groupBy("pattern_a", "pattern_b", "rank_a", "rank_b", "slot_a", "slot_b", "var_type", "size_a", "size_b").agg(F.count("*").alias("common"))
    hits = hits.where(F.col("common") / F.least("size_a", "size_b") > share)
    first = hits.groupBy("pattern_a", "pattern_b", "rank_a", "rank_b").agg(F.min_by("var_type", F.struct("slot_a", "slot_b")).alias("var_type"))
    return first.select("pattern_a", "pattern_b", F.lit("SharedVariable").alias("correlation_type"), F.format_string("share %s values", "var_type").alias("description"), F.lit(0.8).alias("strength"), "rank_a", "rank_b")


def error_cascades(buckets: DataFrame, chosen: DataFrame, least: float = 0.7, lags: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Pairs of a pattern and an error pattern that follows it by one to three minutes; at least six minutes."""
    pairs = _lagged(buckets, chosen, lags).where(~mentions_error(F.col("template_a")) & mentions_error(F.col("template_b")))
    found = pairs.where((F.col("len") >= 6) & (F.col("r") > least))
    first = found.groupBy("pattern_a", "pattern_b", "rank_a", "rank_b").agg(F.min("lag").alias("lag"))
    return first.select("pattern_a", "pattern_b", F.lit("ErrorCascade").alias("correlation_type"), F.format_string("precedes error by ~%dmin", "lag").alias("description"), F.lit(0.9).alias("strength"), "rank_a", "rank_b")


def find_correlations(patterns: DataFrame, slots: DataFrame, tops: DataFrame, buckets: DataFrame) -> DataFrame:
    """All three kinds, the strongest first."""
    chosen = stage(candidates(patterns), "candidates")
    parts = (temporal(buckets, chosen), shared_variables(slots, tops, chosen), error_cascades(buckets, chosen))
    rows = reduce(DataFrame.unionByName, [p.withColumn("kind", F.lit(i)) for i, p in enumerate(parts)])
    return rows.orderBy(F.desc("strength"), "kind", "rank_a", "rank_b").drop("kind", "rank_a", "rank_b")
