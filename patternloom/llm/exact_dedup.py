"""Exact deduplication by progressive refinement (DataFrame operations only).

Texts are equal when identical after lower-casing A-Z. Rows are told apart by ever dearer signatures, and
only rows whose group still holds two or more go on to the next one: (1) length in bytes, (2) hash of the
first ``prefix_chars`` characters, (3) SHA-256 of the whole text. Groups are counted with map-side partial
aggregation and joined back as narrow rows, so a group that holds a third of the table is never in one task
(the joins are plain shuffle joins that adaptive execution may split).

Defined cases: null text counts as empty; null ids take part, but never stay while a non-null id exists in
the group (max ignores nulls); rows that repeat an id are all reported, and rows that share the staying id
are all marked kept; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, ascii_lower, discard, shared_table, without_ids


def _refine(sig: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(n_bytes, prefix_hash) of the groups that survive lengths and prefixes."""
    lengths = shared_table(sig.groupBy("n_bytes").agg(F.count("*").alias("n")).where("n > 1").select("n_bytes"), "lengths")
    same_length = sig.join(lengths, "n_bytes", "left_semi")
    prefixes = shared_table(same_length.groupBy("n_bytes", "prefix_hash").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "prefixes")
    return prefixes, [lengths]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: str = "surviving", prefix_chars: int = 256) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest.

    ``digests="surviving"``: the whole text is hashed only for rows that share length and prefix with
    another row; the others' digest is null. ``digests="all"``: every row is given its digest, in the first
    scan, for callers that report it; refinement then only spares the shuffle of digests.
    """
    norm = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).select("id", ascii_lower(F.col("t")).alias("t"))
    cheap = ["id", F.octet_length("t").cast("long").alias("n_bytes"), F.xxhash64(F.substring("t", 1, prefix_chars)).alias("prefix_hash")]
    full = F.sha2(F.col("t").cast("binary"), 256)
    if digests == "all":
        sig = shared_table(norm.select(*cheap, full.alias("digest")), "signatures")
        prefixes, used = _refine(sig)
        survivors = sig.join(prefixes, ["n_bytes", "prefix_hash"], "left_semi")
    else:
        sig = shared_table(norm.select(*cheap), "signatures")
        prefixes, used = _refine(sig)
        keys = F.broadcast(prefixes) if prefixes.count() <= BROADCAST_ROWS else prefixes  # broadcast: texts stay where they are
        read = norm.select(*cheap, "t").join(keys, ["n_bytes", "prefix_hash"], "left_semi").select("id", full.alias("digest"))
        survivors = shared_table(read, "digests")
    groups = survivors.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = shared_table(groups, "groups")
    if digests == "all":
        out = sig.join(groups, "digest", "left")
    else:
        whole = survivors.join(groups, "digest", "left")
        alone = sig.join(prefixes, ["n_bytes", "prefix_hash"], "left_anti").select("id")
        out = whole.unionByName(alone, allowMissingColumns=True)
    discard(*used)
    keep = F.when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), "digest",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are not kept; columns unchanged. Rows with a null id stay."""
    groups = exact_groups(docs, id_col, text_col)
    gone = shared_table(groups.where(~F.col("kept") & F.col(id_col).isNotNull()).select(id_col), "copies")
    return without_ids(docs, gone, id_col)
