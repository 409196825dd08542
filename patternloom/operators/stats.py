"""Statistics of patterns and of their variable slots. All are partial aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timestamps import minute
from ..functions.variables import declaration_order
from ..sources.staging import partitions_for, stage

SLOT = ["pattern_id", "slot"]
#: Quantiles that slots carry.
QUANTILES = (0.25, 0.5, 0.75, 0.99)


def pattern_stats(assigned: DataFrame) -> DataFrame:
    """pattern_id, count, first_line, last_line, first_ts, last_ts."""
    return assigned.groupBy("pattern_id").agg(
        F.count("*").alias("count"), F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def summary(assigned: DataFrame) -> DataFrame:
    """One row: total_lines, pattern_count, first_ts, last_ts."""
    per = pattern_stats(assigned)
    return per.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_lines"), F.count("*").alias("pattern_count"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def slot_values(variables: DataFrame) -> DataFrame:
    """pattern_id, slot, value, n: how often each value occurs."""
    return variables.groupBy(*SLOT, F.col("raw").alias("value")).agg(F.count("*").alias("n"))


def top_values(values: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent values of each slot: value, n, pct of all, rank from 1; ties by value."""
    whole = values.groupBy(*SLOT).agg(F.sum("n").alias("total"))
    ranked = values.withColumn("rank", F.row_number().over(Window.partitionBy(*SLOT).orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k)
    return ranked.join(whole, SLOT).select(*SLOT, "value", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"), "rank")


def distinct_counts(variables: DataFrame, approximate: bool = False) -> DataFrame:
    """pattern_id, slot, unique_count; approximate: mergeable HyperLogLog sketches of 2**16 registers."""
    if approximate:
        return variables.groupBy(*SLOT).agg(F.hll_sketch_estimate(F.hll_sketch_agg("raw", 16)).alias("unique_count"))
    return slot_values(variables).groupBy(*SLOT).agg(F.count("*").alias("unique_count"))


def _exact_quantiles(numbers: DataFrame, names: list[str]) -> DataFrame:
    """pattern_id, slot and the lower-rank quantiles of ``num``, in ``names``.

    Counts of the distinct values are range-partitioned by slot and value and staged; sums for each slot and partition
    tell where a quantile's rank lies, and only there are counts added up value by value. So a slot's values may fill
    any number of partitions.
    """
    counts = numbers.groupBy(*SLOT, "num").agg(F.count("*").alias("n"))
    rows = counts.repartitionByRange(partitions_for(counts), *SLOT, "num").withColumn("part", F.spark_partition_id())
    rows = stage(rows, "value-counts")
    before = Window.partitionBy(*SLOT).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*SLOT, "part").agg(F.sum("n").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0)))
    parts = parts.join(numbers.groupBy(*SLOT).agg(F.count("*").alias("total")), SLOT)
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("q"), F.greatest(F.ceil(q * F.col("total")), F.lit(1)).alias("rank")) for q, name in zip(QUANTILES, names)]))
    places = parts.select(*SLOT, "part", "m", "before", wanted.alias("w")).where("w.rank > before AND w.rank <= before + m")
    places = places.select(*SLOT, "part", F.col("w.q").alias("q"), (F.col("w.rank") - F.col("before")).alias("rank"))
    some = rows.join(places.select(*SLOT, "part").distinct(), [*SLOT, "part"], "left_semi")
    upto = Window.partitionBy(*SLOT, "part").orderBy("num").rowsBetween(Window.unboundedPreceding, 0)
    some = some.withColumn("upto", F.sum("n").over(upto)).join(places, [*SLOT, "part"]).where("upto >= rank")
    least = some.groupBy(*SLOT, "q").agg(F.min("num").alias("num"))
    return least.groupBy(*SLOT).agg(*[F.max(F.when(F.col("q") == name, F.col("num"))).alias(name) for name in names])


def numeric_stats(variables: DataFrame, approximate: bool = False, accuracy: int = 10_000) -> DataFrame:
    """pattern_id, slot, num_count, sum, mean, min, max, p25, p50, p75, p99 of the values that are numbers. Quantiles are
    lower-rank ones: exact, or within a rank error of 1 / ``accuracy``."""
    numbers = variables.where("num IS NOT NULL")
    names = [f"p{round(q * 100)}" for q in QUANTILES]
    close = [F.percentile_approx("num", F.lit(q), F.lit(accuracy)).cast("double").alias(n) for q, n in zip(QUANTILES, names)] if approximate else []
    rows = numbers.groupBy(*SLOT).agg(
        F.count("*").alias("num_count"), F.sum("num").alias("sum"), F.avg("num").alias("mean"), F.min("num").alias("min"), F.max("num").alias("max"), *close
    )
    return rows if approximate else rows.join(_exact_quantiles(numbers.select(*SLOT, F.col("num").cast("double").alias("num")), names), SLOT)


def majority_type(variables: DataFrame) -> DataFrame:
    """pattern_id, slot, var_type: the most frequent type; ties go to the one declared first."""
    votes = variables.groupBy(*SLOT, "var_type").agg(F.count("*").alias("n"))
    return votes.groupBy(*SLOT).agg(F.max_by("var_type", F.struct("n", -declaration_order(F.col("var_type")))).alias("var_type"))


def enum_slots(values: DataFrame, types: DataFrame, least: int = 50, most_unique: int = 20, share: float = 80.0) -> DataFrame:
    """``types`` with String slots renamed Enum where few values are most of many: at least ``least`` values, at
    most ``most_unique`` distinct ones, the first three at ``share`` per cent or more."""
    few = values.groupBy(*SLOT).agg(F.sum("n").alias("total"), F.count("*").alias("u"))
    top3 = top_values(values, 3).groupBy(*SLOT).agg(F.sum("pct").alias("top3"))
    rows = types.join(few, SLOT).join(top3, SLOT)
    is_enum = (F.col("var_type") == "String") & (F.col("total") >= least) & (F.col("u") <= most_unique) & (F.col("top3") >= share - 1e-9)
    return rows.select(*SLOT, F.when(is_enum, "Enum").otherwise(F.col("var_type")).alias("var_type"))


def slot_stats(variables: DataFrame, approximate: bool = False) -> DataFrame:
    """pattern_id, slot, var_type, total, unique_count and the numeric columns."""
    values = slot_values(variables)
    totals = values.groupBy(*SLOT).agg(F.sum("n").alias("total"), F.count("*").alias("unique_count"))
    types = enum_slots(values, majority_type(variables))
    return types.join(totals, SLOT).join(numeric_stats(variables, approximate), SLOT, "left")


def minute_buckets(assigned: DataFrame) -> DataFrame:
    """pattern_id, minute, n: lines with a timestamp by minute since the epoch."""
    return assigned.where("ts IS NOT NULL").groupBy("pattern_id", minute(F.col("ts")).alias("minute")).agg(F.count("*").alias("n"))


def minute_span(buckets: DataFrame) -> DataFrame:
    """One row: the first minute of all, and ``len``, the number of minutes from there to the last; none without minutes."""
    return buckets.agg(F.min("minute").alias("first"), (F.max("minute") - F.min("minute") + 1).alias("len")).where("first IS NOT NULL")


def dense_buckets(buckets: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Every pattern and every minute from the first to the last of all: pattern_id, at (from 0), minute, n (0 where
    there are none). The one row of bounds is joined to the distinct patterns. For those who want the vectors:
    spikes and correlations are computed from the minutes that have lines."""
    ids = (buckets if patterns is None else patterns).select("pattern_id").distinct()
    grid = ids.join(F.broadcast(minute_span(buckets))).select("pattern_id", F.posexplode(F.sequence("first", F.col("first") + F.col("len") - 1)).alias("at", "minute"))
    return grid.join(buckets, ["pattern_id", "minute"], "left").select("pattern_id", "at", "minute", F.coalesce("n", F.lit(0)).alias("n"))


def sample_lines(assigned: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """pattern_id, line_number, raw: k lines of each pattern, chosen by a seeded hash, in line order. The k smallest
    hashes are kept map-side, so a large pattern is not gathered."""
    if k <= 0:
        return assigned.select("pattern_id", "line_number", "raw").limit(0)
    key = F.struct(F.xxhash64(F.lit(seed), "line_number").alias("h"), "line_number", "raw")
    buckets = assigned.select("pattern_id", F.pmod("line_number", F.lit(64)).alias("b"), key.alias("key"))
    some = lambda rows, *by: rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).where(F.col("r") <= k).drop("r")
    kept = some(some(buckets, "pattern_id", "b"), "pattern_id")
    return kept.select("pattern_id", "key.line_number", "key.raw")


def reduction_pct(pattern_count: Column, total_lines: Column) -> Column:
    return F.when(total_lines > 0, (1 - pattern_count / total_lines) * 100).otherwise(0.0)


