"""From raw lines to timestamps, stripped lines and logtypes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clp
from ..functions.timestamps import extract_timestamp, strip_timestamp


def parse_lines(lines: DataFrame, default_year: int | None = None) -> DataFrame:
    """line_number, raw, ts, ts_family, ts_start, ts_end, stripped, logtype."""
    rows = lines.withColumn("__m", extract_timestamp(F.col("raw"), default_year))
    rows = rows.withColumn("stripped", strip_timestamp(F.col("raw"), F.col("__m")))
    found = [F.col(f"__m.{c}").alias(n) for c, n in (("ts", "ts"), ("family", "ts_family"), ("start", "ts_start"), ("end", "ts_end"))]
    return rows.select("line_number", "raw", *found, "stripped", clp.logtype(F.col("stripped")).alias("logtype"))


def compacted(parsed: DataFrame) -> DataFrame:
    """Parsed lines as they are staged: without the stripped line, and without logtypes that equal it."""
    return parsed.withColumn("logtype", F.nullif("logtype", "stripped")).drop("stripped")


def expanded(rows: DataFrame) -> DataFrame:
    """What :func:`compacted` was given."""
    match = F.when(F.col("ts_start").isNotNull(), F.struct(F.col("ts_start").alias("start"), F.col("ts_end").alias("end")))
    rows = rows.withColumn("stripped", strip_timestamp(F.col("raw"), match))
    return rows.withColumn("logtype", F.coalesce("logtype", "stripped"))


def logtype_counts(parsed: DataFrame) -> DataFrame:
    """logtype, n, first_line: the dictionary of a table of lines."""
    return parsed.groupBy("logtype").agg(F.count("*").alias("n"), F.min("line_number").alias("first_line"))
