"""Line sources: (line_number, raw), numbered from 1 over the lines that are not empty."""

from __future__ import annotations

from functools import reduce
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .staging import partitions_for, spool, stage


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``rank``, from 1 in that order, without one task seeing them all.

    Rows are range-partitioned and sorted by the order; each row's rank is its place in its partition plus the
    sizes of the partitions before, of which there are as many as partitions. The sorted rows are staged, so
    that sizes and places come from one and the same partitioning.
    """
    sorted_ = rows.repartitionByRange(partitions_for(rows), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    local = stage(sorted_.select("*", F.spark_partition_id().alias("__part"), at.alias("__at")), "sorted")
    sizes = local.groupBy("__part").agg(F.count("*").alias("size"))
    before = sizes.select(F.col("__part"), (F.sum("size").over(Window.orderBy("__part")) - F.col("size")).alias("__before"))
    return local.join(F.broadcast(before), "__part").withColumn("rank", F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def number_lines(lines: DataFrame, *order: str | Column) -> DataFrame:
    """Number the lines of ``lines`` (raw, and the columns of ``order``) that are not empty, in that order."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"__k{i}" for i in range(len(cols))]
    keyed = lines.where(F.length("raw") > 0).select("raw", *[c.alias(n) for c, n in zip(cols, names)])
    return ranked(keyed, *names).select(F.col("rank").alias("line_number"), "raw")


def read_log_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Text files, split at line feeds only; trailing carriage returns go, bytes that are not UTF-8 become U+FFFD."""
    files = spark.read.option("lineSep", "\n").text(list(paths))
    raw = F.regexp_replace(F.make_valid_utf8("value"), r"\r+\z", "")
    meta = files.select(raw.alias("raw"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return number_lines(meta, "path", "block", "at")


def read_stream(spark: SparkSession, source: BinaryIO) -> DataFrame:
    """Lines of a stream of bytes, such as standard input, as those of a file. The stream is copied to the shared folder in
    blocks, so it is never whole in memory."""
    return read_log_files(spark, spool(spark, source))


def lines_of_text(spark: SparkSession, text: str) -> DataFrame:
    """Lines of one string, split at line feeds, one carriage return before each removed."""
    rows = spark.createDataFrame([(text,)], T.StructType([T.StructField("text", T.StringType())]))
    parts = rows.select(F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return number_lines(parts.select("at", F.regexp_replace("line", r"\r\z", "").alias("raw")), "at")


def lines_of_column(table: DataFrame, text_col: str, *order: str) -> DataFrame:
    """Lines of a text column, in the order of the given columns and then within each text."""
    parts = table.select(*order, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("at", "line"))
    return number_lines(parts.select(*order, "at", F.regexp_replace("line", r"\r\z", "").alias("raw")), *order, "at")


def union_sources(*sources: DataFrame) -> DataFrame:
    """Several line sources one after the other."""
    tagged = [s.select("raw", "line_number", F.lit(i).alias("source")) for i, s in enumerate(sources)]
    return number_lines(reduce(DataFrame.unionByName, tagged), "source", "line_number")


def stream_log_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files that arrive in a folder; not numbered."""
    files = spark.readStream.option("lineSep", "\n").text(path)
    return files.select(F.regexp_replace(F.make_valid_utf8("value"), r"\r+\z", "").alias("raw")).where(F.length("raw") > 0)
