"""Chat formatting with multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that participant as the
assistant, everybody else as a named user, and a mask over what the assistant says (its text and the end
mark). Participants are the distinct speakers other than ``system_role``, whose turns stay system turns.

    <|system|>text<|end|>   <|user:NAME|>text<|end|>   <|assistant|>text<|end|>

A rendering is a sequence of chunks of at most ``chunk_turns`` turns, in order, so that a conversation of any
length is never gathered by one task. Turns are numbered within their conversation by a range-partitioned
sort (ties are dealt out by a last sort key, so equal rows do not pile up either) and per-partition counts;
only as many numbers as there are partitions reach the driver, and the sampled range keys, which hold 128 characters of a
text at most. Mask spans are character offsets in the chunk's text.

Defined cases: a null speaker is "unknown"; null text counts as empty; a null conversation id is a
conversation of its own; null turns come first; ties are ordered by speaker, then text (where they fall in two
partitions, texts that are equal in their first 128 characters by hash), and repeated rows are
rendered as often as they occur; ``<|`` in texts and names is written ``<\\|`` so that texts cannot forge
marks; a conversation with system turns only has no participant and no rendering; an empty table gives no
rows; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import partitions_for, shared_table


def _numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with ``n``, the row's number (from 0) in its conversation."""
    spark = turns.sparkSession
    keys = ["conv", "turn", "speaker", "body"]
    # the keys that are sampled for ranges hold no whole text
    rows = turns.withColumns({"head": F.substring("body", 1, 128), "rest": F.xxhash64("body"), "tie": F.xxhash64(*keys, F.monotonically_increasing_id())})
    rows = rows.repartitionByRange(partitions_for(turns), "conv", "turn", "speaker", "head", "rest", "tie")
    rows = rows.sortWithinPartitions(*keys, "tie").select(*keys)
    rows = shared_table(rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "turns")
    sizes = sorted((r[0], r[1]) for r in rows.groupBy("part").count().collect())
    before, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    offsets = spark.createDataFrame(offsets, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType())]))
    placed = rows.join(F.broadcast(offsets), "part").withColumn("g", F.col("before") + F.col("at"))
    first = shared_table(placed.groupBy("conv").agg(F.min("g").alias("g0")).withColumnRenamed("conv", "c"), "conversations")
    return placed.join(first, F.col("conv").eqNullSafe(F.col("c"))).select(*keys, (F.col("g") - F.col("g0")).alias("n"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system_role: str = "system", chunk_turns: int = 256) -> DataFrame:
    """conv, perspective, chunk (from 0), n_turns, text, mask (array of start and end) for every participant."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<\\|"))
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("speaker"), safe(F.coalesce(F.col(text_col), F.lit(""))).alias("body"),
    )
    who = rows.where(F.col("speaker") != system_role).select(F.col("conv").alias("c"), F.col("speaker").alias("perspective")).distinct()
    who = shared_table(who, "participants")
    chunks = _numbered(rows).withColumn("chunk", F.floor(F.col("n") / chunk_turns).cast("int"))
    chunks = chunks.groupBy("conv", "chunk").agg(F.array_sort(F.collect_list(F.struct("n", "speaker", "body"))).alias("turns"))
    chunks = shared_table(chunks, "chunks")
    each = chunks.join(who, F.col("conv").eqNullSafe(F.col("c")))
    mark = lambda t: (
        F.when(t["speaker"] == system_role, F.lit("<|system|>")).when(t["speaker"] == F.col("perspective"), F.lit("<|assistant|>")).otherwise(F.concat(F.lit("<|user:"), safe(t["speaker"]), F.lit("|>")))
    )
    parts = F.transform("turns", lambda t: F.struct(mark(t).alias("mark"), F.concat(t["body"], F.lit("<|end|>")).alias("said"), (t["speaker"] == F.col("perspective")).alias("own")))
    each = each.select("conv", "perspective", "chunk", parts.alias("parts"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask"))

    def step(acc, p):
        start = acc["at"] + F.length(p["mark"])
        end = start + F.length(p["said"])
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(p["own"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    mask = F.aggregate("parts", zero, step, lambda acc: acc["mask"])
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["mark"], p["said"])), "")
    return each.select(F.col("conv").alias(conv_col), "perspective", "chunk", F.size("parts").alias("n_turns"), text.alias("text"), mask.alias("mask"))
