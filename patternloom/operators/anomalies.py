"""Anomalies of patterns: pattern_id, type, var_slot, unique_count, severity, description."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import has_error_token
from .stats import minute_span

# fixed values: severities
HIGH_ERROR_RATE, LOW_CARDINALITY, CLUSTERED, BIMODAL = 0.9, 0.6, 0.5, 0.4


def _rows(found: DataFrame, kind: str, severity: Column, description: Column, slot: bool = False, unique: bool = False) -> DataFrame:
    return found.select(
        "pattern_id", F.lit(kind).alias("type"), (F.col("slot") if slot else F.lit(None)).cast("int").alias("var_slot"),
        (F.col("unique_count") if unique else F.lit(None)).cast("long").alias("unique_count"), severity.cast("double").alias("severity"), description.alias("description"),
    )


def spike_ratios(buckets: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """pattern_id, late_ratio, early_ratio: rate of the last tenth of minutes over that before, and of the first
    tenth over the rest; null where the lower rate is zero. No rows if there are fewer than five minutes. Minutes without
    lines count by the span's length; they need no rows."""
    span = F.broadcast(minute_span(buckets).where("len >= 5"))
    rows = buckets.join(span).withColumn("at", F.col("minute") - F.col("first"))
    split = F.floor(F.col("len") * 0.9)
    begin = F.greatest(F.floor(F.col("len") * 0.1), F.lit(1))
    part = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    sums = rows.groupBy("pattern_id").agg(
        part(F.col("at") < split).alias("head"), part(F.col("at") >= split).alias("tail"), part(F.col("at") < begin).alias("begin"), part(F.col("at") >= begin).alias("rest")
    )
    if patterns is not None:
        sums = patterns.select("pattern_id").distinct().join(sums, "pattern_id", "left").fillna(0, ["head", "tail", "begin", "rest"])
    sums = sums.join(span)
    rate = lambda c, n: F.try_divide(F.col(c).cast("double"), n.cast("double"))
    late = F.when(F.col("head") > 0, F.try_divide(rate("tail", F.col("len") - split), rate("head", split)))
    early = F.when(F.col("rest") > 0, F.try_divide(rate("begin", begin), rate("rest", F.col("len") - begin)))
    return sums.select("pattern_id", late.alias("late_ratio"), early.alias("early_ratio"))


def frequency_spikes(buckets: DataFrame, factor: float = 3.0) -> DataFrame:
    ratios = spike_ratios(buckets)
    late = F.col("late_ratio") > factor
    ratio = F.when(late, F.col("late_ratio")).when(F.col("early_ratio") > factor, F.col("early_ratio"))
    found = ratios.select("pattern_id", ratio.alias("ratio"), F.coalesce(late, F.lit(False)).alias("late")).where("ratio IS NOT NULL")
    text = F.format_string("%s (%.1fx)", F.when(F.col("late"), "rate rose in the last tenth of the time").otherwise("burst in the first tenth of the time"), F.col("ratio"))
    return _rows(found, "FrequencySpike", F.least(F.col("ratio") / 10, F.lit(1.0)), text)


def error_patterns(patterns: DataFrame) -> DataFrame:
    found = patterns.where(has_error_token(F.col("template")))
    return _rows(found, "HighErrorRate", F.lit(HIGH_ERROR_RATE), F.lit("the template names an error"))


def low_cardinality(patterns: DataFrame, slots: DataFrame, least: int = 100, unique: int = 5) -> DataFrame:
    found = slots.join(patterns.where(F.col("count") > least).select("pattern_id"), "pattern_id").where(F.col("unique_count") < unique)
    return _rows(found, "LowCardinality", F.lit(LOW_CARDINALITY), F.format_string("slot %d has %d distinct values", "slot", "unique_count"), slot=True, unique=True)


def clustered_numeric(slots: DataFrame, least: int = 50, spread: float = 0.05) -> DataFrame:
    found = slots.where((F.col("num_count") > least) & (F.col("mean") > 0)).where((F.col("max") - F.col("min")) / F.col("mean") < spread)
    return _rows(found, "ClusteredNumeric", F.lit(CLUSTERED), F.format_string("slot %d stays near its mean", "slot"), slot=True)


def bimodal(slots: DataFrame, least: int = 50, ratio: float = 5.0) -> DataFrame:
    found = slots.where((F.col("num_count") > least) & (F.col("p25") > 0)).where(F.col("p75") / F.col("p25") > ratio)
    return _rows(found, "BimodalDistribution", F.lit(BIMODAL), F.format_string("slot %d has quartiles far apart", "slot"), slot=True)


def detect_anomalies(patterns: DataFrame, slots: DataFrame, buckets: DataFrame) -> DataFrame:
    """All of them, one row each."""
    parts = (frequency_spikes(buckets), error_patterns(patterns), low_cardinality(patterns, slots), clustered_numeric(slots), bimodal(slots))
    return reduce(DataFrame.unionByName, parts)


def by_pattern(anomalies: DataFrame) -> DataFrame:
    """Patterns with anomalies, the most severe first: pattern_id, max_severity, anomalies."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("severity")).alias("order"), "type", "var_slot", "severity", "description")))
    return anomalies.groupBy("pattern_id").agg(F.max("severity").alias("max_severity"), items.alias("anomalies")).orderBy(F.desc("max_severity"), "pattern_id")
