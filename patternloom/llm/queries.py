"""The registered queries of this subpackage and the SQL that states them."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, language_id, packing, quality, simhash, substring_dedup, toxicity, url_filters
from ._common import finished

#: Rules of the URL filter query: host, path, verdict.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(_read(spark, sf_dir, "documents"), digests="all")
    return out.withColumnRenamed("digest", "text_sha256")


def _pages_identified(spark: SparkSession, sf_dir: str, model: language_id.TextModel) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select(
        "page_id", language_id.host_of(F.col("url")).alias("host"),
        language_id.declared_language(F.col("html")).alias("declared"), language_id.visible_text(F.col("html")).alias("text"),
    )
    return language_id.identify(pages, model, "page_id", host_col="host", declared_col="declared")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by text and source (doc_id), and pages by visible text, declared language, address suffix, site and host
    (page_id). The text model is fitted on the documents' lang labels, which scores never read."""
    docs = _read(spark, sf_dir, "documents")
    model = language_id.fit_text_model(docs)
    found = (language_id.identify(docs, model, host_col="source"), _pages_identified(spark, sf_dir, model))
    found = found[0].unionByName(found[1], allowMissingColumns=True)
    return found.select("doc_id", "page_id", F.col("lang").alias("predicted_lang"), "probability", F.col("accepted").alias("kept"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages alone, with their evidence as in op2."""
    out = _pages_identified(spark, sf_dir, language_id.fit_text_model(_read(spark, sf_dir, "documents")))
    return out.select("page_id", F.col("lang").alias("predicted_lang"), "probability", "accepted")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_read(spark, sf_dir, "documents")).drop("kept_text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.withColumn("toxic", F.col("grade") >= 1)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS r(rule_host, rule_path, rule_verdict)")
    return url_filters.match_rules(_read(spark, sf_dir, "pages"), rules)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return packing.best_fit_pack(docs, source=F.col("source"), cluster=packing.content_cluster(F.col("text")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))  # a null id has no remainder
    out = quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), usable=~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as text, like ``14-60,81-99``."""
    out = chat.rotate(_read(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return out.select("conv_id", "perspective", "chunk", F.col("n_turns").cast("long").alias("n_turns"), "text", spans.alias("mask"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_BY_LENGTH = sorted(URL_RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))

SQL = {
    "op1_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS h FROM documents),
        g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM t JOIN g USING (h)""",
    "op3_substring_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
        w AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM d)),
        r AS (SELECT doc_id, s, min(doc_id * 100000000 + s) OVER (PARTITION BY k) < doc_id * 100000000 + s AS again FROM w),
        c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r WHERE again),
        p AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
        k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM p ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op5_url_filters": f"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r AS (SELECT *, CASE {" ".join(f"WHEN {_FITS.format(h, p)} THEN '{h}{p}'" for h, p, _ in _BY_LENGTH)} END AS rule FROM h)
        SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in URL_RULES)} ELSE 'allow' END AS verdict FROM r""",
    "op6_decontaminate": r"""
        WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
        w AS (SELECT kind, id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM t),
        s AS (SELECT DISTINCT kind, id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'b' GROUP BY id)
        SELECT d.id AS doc_id, b.id AS item_id, count(*)::INTEGER AS shared, any_value(n)::INTEGER AS item_shingles, count(*) / any_value(n) AS containment
        FROM s b JOIN s d ON b.g = d.g AND b.kind = 'b' AND d.kind = 'd' JOIN n ON n.id = b.id
        GROUP BY ALL HAVING count(*) >= 0.8 * any_value(n) - 1e-9""",
    "op10_chat_rotation": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS who, replace(coalesce(text, ''), '<|', '<\|') || '<|end|>' AS said FROM conversations),
        p AS (SELECT DISTINCT conv_id AS cid, who AS perspective FROM c WHERE who <> 'system'),
        m AS (SELECT *, CASE WHEN who = 'system' THEN '<|system|>' WHEN who = perspective THEN '<|assistant|>' ELSE '<|user:' || replace(who, '<|', '<\|') || '|>' END AS mark
              FROM c JOIN p ON cid IS NOT DISTINCT FROM conv_id),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, who, said) - 1 AS k FROM m),
        o AS (SELECT *, sum(length(mark) + length(said)) OVER (PARTITION BY conv_id, perspective, k // 256 ORDER BY k) AS stop FROM n)
        SELECT conv_id, perspective, (k // 256)::INTEGER AS chunk, count(*) AS n_turns, string_agg(mark || said, '' ORDER BY k) AS text,
               coalesce(string_agg((stop - length(said))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY k) FILTER (WHERE who = perspective), '') AS mask
        FROM o GROUP BY conv_id, perspective, k // 256""",
}


def queries() -> dict:
    fs = (op1_exact_dedup, op2_language_id, op3_substring_dedup, op4_toxicity, op5_url_filters, op6_decontaminate, op7_best_fit_packing, op8_simhash, op9_quality, op10_chat_rotation, language_id_pages)
    return {f.__name__: f if f is op10_chat_rotation else _alone(f) for f in fs}


def _alone(query):
    """The query with its narrow result staged, and what was staged for it deleted. Op10's result is whole texts: it is not
    written a second time."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return finished(lambda: query(spark, sf_dir), query.__name__)

    return run


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
