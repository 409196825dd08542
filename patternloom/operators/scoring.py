"""Scores: count x keyword weight x (1 + the pattern's largest anomaly severity)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.severity import keyword_weight, severity


def score_patterns(patterns: DataFrame, anomalies: DataFrame) -> DataFrame:
    """``patterns`` with keyword_weight, severity and score."""
    worst = anomalies.groupBy("pattern_id").agg(F.max("severity").alias("__worst"))
    rows = patterns.join(worst, "pattern_id", "left").withColumn("keyword_weight", keyword_weight(F.col("template")))
    score = F.col("count") * F.col("keyword_weight") * (1 + F.coalesce("__worst", F.lit(0.0)))
    return rows.withColumns({"severity": severity(F.col("keyword_weight")), "score": score}).drop("__worst")


def top_patterns(patterns: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent patterns; ties by id."""
    return patterns.orderBy(F.desc("count"), "pattern_id").limit(n)


def critical_patterns(scored: DataFrame, n: int = 20) -> DataFrame:
    """Error and warn patterns by score, then count, then id."""
    return scored.where(F.col("severity").isin("error", "warn")).orderBy(F.desc("score"), F.desc("count"), "pattern_id").limit(n)


def high_volume_patterns(scored: DataFrame, n: int = 5) -> DataFrame:
    """The most frequent of the others."""
    return scored.where(~F.col("severity").isin("error", "warn")).orderBy(F.desc("count"), "pattern_id").limit(n)
