"""The registered queries of the log engine over the standard tables, and DuckDB SQL that states them.

Log lines are made from ``events`` by one expression that both engines understand: ``mixed_lines`` with all
timestamp families, ``service_lines`` with one shape for each event type, whose patterns and variables the SQL
can name without mining them.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clp, labels, severity, variables
from ..operators import anomalies, correlations, drain, extract, scoring, stats
from ..operators.parse import logtype_counts, parse_lines
from ..reports.model import Options, gather
from ..reports.render import json_text
from ..sources.lines import lines_of_column
from ..sources.staging import finished
from .decompose import Decomposition

YEAR = 2024

_S = "CAST({} AS STRING)"
_DAY, _CLOCK = "substr(CAST(ts AS STRING), 9, 2)", "substr(CAST(ts AS STRING), 12, 8)"
_DATE = "substr(CAST(ts AS STRING), 1, 10)"
_MONTH = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * CAST(substr(CAST(ts AS STRING), 6, 2) AS INT) - 2, 3)"
_WEEKDAY = f"substr('MonTueWedThuFriSatSun', 3 * ((CAST({_DAY} AS INT) - 1) % 7) + 1, 3)"
_PART = lambda a: f"CAST(substr(CAST(ts AS STRING), {a}, 2) AS BIGINT)"
_EPOCH = f"CAST(1704067200 + ({_PART(9)} - 1) * 86400 + {_PART(12)} * 3600 + {_PART(15)} * 60 + {_PART(18)} AS STRING)"
_MS = "lpad(CAST(event_id % 1000 AS STRING), 3, '0')"
_ISO = f"{_DATE} || 'T' || {_CLOCK} || '.' || {_MS} || 'Z '"
_PREFIX = f"""CASE event_id % 10
    WHEN 4 THEN {_DATE} || 'T' || {_CLOCK} || '+05:30 '
    WHEN 5 THEN '10.0.0.1 - - [' || {_DAY} || '/' || {_MONTH} || '/2024:' || {_CLOCK} || ' +0000] '
    WHEN 6 THEN {_MONTH} || ' ' || {_DAY} || ' ' || {_CLOCK} || ' host1 '
    WHEN 7 THEN '[' || {_WEEKDAY} || ' ' || {_MONTH} || ' ' || {_DAY} || ' ' || {_CLOCK} || ' 2024] '
    WHEN 8 THEN 'ts=' || {_EPOCH} || ' '
    WHEN 9 THEN ''
    ELSE {_ISO} END"""
_HEX = "'a' || lpad(CAST(event_id AS STRING), 8, '0') || 'f'"
#: Variables of each event type's lines, in order.
_SLOTS = {
    "view": (_HEX, "'10.0.' || CAST(user_id % 4 AS STRING) || '.' || CAST(user_id % 250 AS STRING)", "CAST(event_id * 37 % 900 AS STRING) || 'ms'", "CASE WHEN event_id % 17 = 0 THEN '500' ELSE '200' END"),
    "click": ("'k' || CAST(user_id % 30 AS STRING)", "CAST(event_id % 3 AS STRING) || '.' || lpad(CAST(event_id % 100 AS STRING), 2, '0')", "CASE WHEN event_id % 2 = 0 THEN 'hit' ELSE 'miss' END"),
    "error": (_HEX, "'10.0.1.' || CAST(user_id % 9 AS STRING)", "'5432'", "CAST(5000 + event_id % 7 AS STRING) || 'ms'"),
    "purchase": ("CAST(user_id AS STRING)", "CAST(event_id * 13 % 997 AS STRING) || '.' || lpad(CAST(event_id % 100 AS STRING), 2, '0')", "'fast'", "'face'"),
    "signup": ("CAST(event_id % 1500 AS STRING) || 'ms'",),
}
_SHAPES = {
    "view": "INFO [{}] Request from {} completed in {} status={}",
    "click": "DEBUG cache lookup key={} ratio {} {}",
    "error": "ERROR [{}] Timeout connecting to {}:{} after {}",
    "purchase": "INFO payment user={} amount {} USD mode={} {}",
    "signup": "WARN Connection pool exhausted, waiting {}",
}
_SHOWN = {k: "<TS> " + s.replace("{}", "<*>") for k, s in _SHAPES.items()}


def _body(kind: str) -> str:
    parts = _SHAPES[kind].split("{}")
    out = f"'{parts[0]}'"
    for slot, const in zip(_SLOTS[kind], parts[1:]):
        out += f" || ({slot})" + (f" || '{const}'" if const else "")
    return out


_BODY = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {_body(k)}" for k in _SHAPES) + " END"
_LINES = "SELECT event_id + 1 AS line_number, event_type, ts, user_id, event_id, {} || " + _BODY + " AS raw FROM events"
MIXED, SERVICE = _LINES.format(_PREFIX), _LINES.format(_ISO)


def _lines(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(text.replace("FROM events", "FROM {events}"), events=events).select("line_number", "raw")


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, MIXED)


def service_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, SERVICE)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(mixed_lines(spark, sf_dir), YEAR)


def _analysis(spark: SparkSession, sf_dir: str, **how) -> Decomposition:
    return Decomposition(service_lines(spark, sf_dir), **how)


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


# -- sources, timestamps, tokens ---------------------------------------------------------------------------


def nonempty_lines(spark, sf_dir):
    return lines_of_column(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", "doc_id")


def ts_extract(spark, sf_dir):
    from ..functions.timestamps import extract_timestamp

    m = F.col("m")
    rows = mixed_lines(spark, sf_dir).withColumn("m", extract_timestamp(F.col("raw"), YEAR))
    return rows.select("line_number", F.unix_micros(m["ts"]).alias("ts_us"), m["family"].alias("family"), m["start"].cast("long").alias("start_at"), m["end"].cast("long").alias("end_at"))


def ts_strip(spark, sf_dir):
    return _parsed(spark, sf_dir).select("line_number", "stripped")


def ts_family_counts(spark, sf_dir):
    return _parsed(spark, sf_dir).groupBy(F.coalesce("ts_family", F.lit("none")).alias("family")).agg(F.count("*").alias("n"))


def clp_logtype(spark, sf_dir):
    return _parsed(spark, sf_dir).select("line_number", "logtype")


def clp_variables(spark, sf_dir):
    found = _parsed(spark, sf_dir).select("line_number", F.posexplode(clp.variables(F.col("stripped"))).alias("place", "var"))
    return found.select("line_number", F.col("place").cast("long").alias("place"), "var", clp.kind(F.col("var")).alias("kind"), clp.kind(F.col("var"), 4).alias("kind4"))


def _distinct_vars(spark, sf_dir):
    return clp_variables(spark, sf_dir).select("var", "kind", "kind4").distinct()


def clp_int_codec(spark, sf_dir):
    code = clp.encode_int(F.col("var"))
    return _distinct_vars(spark, sf_dir).where("kind = 'I'").select("var", code.alias("code"), clp.decode_int(code).alias("decoded"))


def clp_float_codec(spark, sf_dir):
    code = clp.encode_float(F.col("var"))
    return _distinct_vars(spark, sf_dir).where("kind = 'F'").select("var", code.alias("code"), clp.decode_float(code).alias("decoded"))


def clp_float_codec4(spark, sf_dir):
    code = clp.encode_float(F.col("var"), 4)
    return _distinct_vars(spark, sf_dir).where("kind4 = 'F'").select("var", code.cast("long").alias("code"), clp.decode_float(code, 4).alias("decoded"))


def clp_roundtrip(spark, sf_dir):
    m = F.col("m")
    rows = mixed_lines(spark, sf_dir).withColumn("m", clp.encode_message(F.col("raw")))
    return rows.select("line_number", clp.decode_message(m["logtype"], m["encoded_vars"], m["dictionary_vars"]).alias("raw"))


def clp_placeholder_counts(spark, sf_dir):
    n = clp.placeholder_counts(F.col("logtype"))
    return _parsed(spark, sf_dir).select("line_number", n["encoded"].cast("long").alias("encoded"), n["dictionary"].cast("long").alias("dictionary"))


def clp_logtype_counts(spark, sf_dir):
    return logtype_counts(_parsed(spark, sf_dir))


def document_logtypes(spark, sf_dir):
    lines = nonempty_lines(spark, sf_dir)
    return lines.select(clp.logtype(F.col("raw")).alias("logtype")).groupBy("logtype").agg(F.count("*").alias("n"))


def classify_variables(spark, sf_dir):
    typed = _distinct_vars(spark, sf_dir).select("var").withColumn("var_type", variables.classify(F.col("var")))
    return typed.withColumn("num", F.round(variables.numeric_value(F.col("var"), F.col("var_type")), 6))


# -- patterns, slots ----------------------------------------------------------------------------------------


def drain_clusters(spark, sf_dir):
    """Lines of all families, clustered in order."""
    assigned = Decomposition(mixed_lines(spark, sf_dir), default_year=YEAR).assigned
    shown = extract.display_templates(drain.templates(assigned))
    return stats.pattern_stats(assigned).join(shown, "pattern_id").select("pattern_id", "template", "count", "first_line")


def drain_documents(spark, sf_dir):
    """Document lines, each distinct logtype once."""
    parsed = Decomposition(lambda: nonempty_lines(spark, sf_dir), default_year=YEAR).parsed
    assigned = drain.assign_patterns(parsed, "distinct")
    return stats.pattern_stats(assigned).select("pattern_id", "count", "first_line", "last_line")


def final_templates(spark, sf_dir):
    return _analysis(spark, sf_dir).templates.select("pattern_id", "template")


def template_match(spark, sf_dir):
    d = _analysis(spark, sf_dir)
    return drain.match_templates(d.assigned, d.templates)


def pattern_span(spark, sf_dir):
    rows = stats.pattern_stats(_analysis(spark, sf_dir).assigned)
    return rows.select("pattern_id", "count", "first_line", "last_line", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


def global_summary(spark, sf_dir):
    rows = _analysis(spark, sf_dir).summary.withColumn("reduction", F.round(stats.reduction_pct(F.col("pattern_count"), F.col("total_lines")), 6))
    return rows.select("total_lines", "pattern_count", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "reduction")


def line_variables(spark, sf_dir):
    return _analysis(spark, sf_dir).variables.select("line_number", "pattern_id", F.col("slot").cast("long").alias("slot"), "raw", "var_type")


def _slots(df: DataFrame, *cols) -> DataFrame:
    return df.select("pattern_id", F.col("slot").cast("long").alias("slot"), *cols)


def type_majority(spark, sf_dir):
    return _slots(stats.majority_type(_analysis(spark, sf_dir).variables), "var_type")


def enum_reclass(spark, sf_dir):
    v = _analysis(spark, sf_dir).variables
    return _slots(stats.enum_slots(stats.slot_values(v), stats.majority_type(v)), "var_type")


def numeric_stats(spark, sf_dir):
    rows = _round(stats.numeric_stats(_analysis(spark, sf_dir).variables), "sum", "mean", "min", "max", "p25", "p50", "p75", "p99")
    return _slots(rows, "num_count", "sum", "mean", "min", "max", "p25", "p50", "p75", "p99")


def value_topk(spark, sf_dir):
    rows = _round(stats.top_values(stats.slot_values(_analysis(spark, sf_dir).variables), 10), "pct")
    return _slots(rows, "value", "n", "pct", F.col("rank").cast("long").alias("rank"))


def distinct_counts(spark, sf_dir):
    return _slots(stats.distinct_counts(_analysis(spark, sf_dir).variables), "unique_count")


def approx_distinct(spark, sf_dir):
    return _slots(stats.distinct_counts(_analysis(spark, sf_dir).variables, True), "unique_count")


def approx_quantiles(spark, sf_dir):
    rows = stats.numeric_stats(_analysis(spark, sf_dir).variables, True)
    return _slots(rows, "p25", "p50", "p75", "p99")


def minute_buckets(spark, sf_dir):
    return _analysis(spark, sf_dir).buckets


def dense_buckets(spark, sf_dir):
    rows = _analysis(spark, sf_dir).dense
    return rows.groupBy("pattern_id").agg(F.count("*").alias("minutes"), F.sum("n").alias("total"), F.max("n").alias("most"), F.sum(F.col("n") * F.col("at")).alias("moment"))


def reservoir_examples(spark, sf_dir):
    return stats.sample_lines(_analysis(spark, sf_dir).assigned, 3)


# -- anomalies, scores, correlations -------------------------------------------------------------------------


def frequency_spike_ratios(spark, sf_dir):
    d = _analysis(spark, sf_dir)
    return _round(anomalies.spike_ratios(d.buckets, d.templates), "late_ratio", "early_ratio")


def anomaly_rows(spark, sf_dir):
    rows = _round(_analysis(spark, sf_dir).anomalies, "severity")
    return rows.select("pattern_id", "type", F.col("var_slot").cast("long").alias("var_slot"), "unique_count", "severity")


def severity_score(spark, sf_dir):
    return _round(_analysis(spark, sf_dir).patterns, "score").select("pattern_id", "count", "keyword_weight", "severity", "score")


def keyword_weight(spark, sf_dir):
    """Over the first 200 characters of document lines, so that prefixes are cut."""
    rows = nonempty_lines(spark, sf_dir).withColumn("w", severity.keyword_weight(F.col("raw")))
    return rows.groupBy("w").agg(F.count("*").alias("n"), F.count_if(severity.has_error_token(F.col("raw"))).alias("errors"), F.count_if(severity.mentions_error(F.col("raw"))).alias("mentions"))


def topn_patterns(spark, sf_dir):
    d = _analysis(spark, sf_dir)
    total = d.counted.agg(F.sum("count").alias("total"))
    top = scoring.top_patterns(d.counted, 3).join(F.broadcast(total))
    return top.select("pattern_id", "template", "count", F.round(F.col("count") * 100 / F.col("total"), 6).alias("pct"))


def llm_sections(spark, sf_dir):
    d = _analysis(spark, sf_dir)
    part = lambda rows, name: _round(rows, "score").select(F.lit(name).alias("section"), "pattern_id", "score")
    return part(scoring.critical_patterns(d.patterns, 2), "critical").unionByName(part(scoring.high_volume_patterns(d.patterns, 2), "high"))


def temporal_pairs(spark, sf_dir):
    """Pearson's r of every pair of patterns, before the threshold."""
    d = _analysis(spark, sf_dir)
    return _round(correlations.temporal(d.buckets, correlations.candidates(d.counted), -1.0), "strength").select("pattern_a", "pattern_b", "strength")


def shared_variables(spark, sf_dir):
    d = _analysis(spark, sf_dir)
    return correlations.shared_variables(d.slots, d.top_values, correlations.candidates(d.counted), 0.05).select("pattern_a", "pattern_b", "description", "strength")


def error_cascade(spark, sf_dir):
    """With the threshold at -1, so that every pair of a pattern and an error pattern has its first lag."""
    d = _analysis(spark, sf_dir)
    return correlations.error_cascades(d.buckets, correlations.candidates(d.counted), -1.0).select("pattern_a", "pattern_b", "description", "strength")


def correlation_report(spark, sf_dir):
    return _analysis(spark, sf_dir).correlations


def infer_labels(spark, sf_dir):
    return _slots(_analysis(spark, sf_dir).slots, "label")


def truncate_tokens(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return rows.select("page_id", labels.truncate_long_tokens(F.col("html")).alias("short"))


def decompose_full(spark, sf_dir):
    """All lines of all families: templates with counts, severities and scores."""
    d = Decomposition(mixed_lines(spark, sf_dir), default_year=YEAR)
    return d.patterns.select("pattern_id", "template", "count", "severity", F.round("score", 6).alias("score"))


def decompose_json(spark, sf_dir):
    d = _analysis(spark, sf_dir, context=2)
    options = Options(context=2, format="json")
    return spark.createDataFrame([(json_text(gather(d, options), options),)], "report string")


# -- the same in SQL -------------------------------------------------------------------------------------------

_WORD = r"[A-Za-z0-9+\-._]"
_RUNS = rf"({_WORD}+|[^A-Za-z0-9+\-._]+)"
_MIXED_TS = rf"""
l AS ({MIXED}),
m AS (SELECT line_number, raw,
    regexp_extract(raw, '\[[A-Z][a-z]{{2}} [A-Z][a-z]{{2}} [ \d]\d \d{{2}}:\d{{2}}:\d{{2}} \d{{4}}\]') AS a,
    regexp_extract(raw, '\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?(Z|[+-]\d{{2}}:?\d{{2}})?') AS i,
    regexp_extract(raw, '\d{{2}}/[A-Z][a-z]{{2}}/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}} [+-]\d{{4}}') AS c,
    regexp_extract(raw, '[A-Z][a-z]{{2}} [ \d]\d \d{{2}}:\d{{2}}:\d{{2}}') AS s,
    regexp_extract(raw, '\b1[0-9]{{9}}(?:[0-9]{{3}})?\b') AS e FROM l),
t AS (SELECT *, CASE WHEN a <> '' THEN 'apache' WHEN i <> '' THEN 'iso' WHEN c <> '' THEN 'common_log' WHEN s <> '' THEN 'syslog' WHEN e <> '' THEN 'epoch' END AS family,
    CASE WHEN a <> '' THEN a WHEN i <> '' THEN i WHEN c <> '' THEN c WHEN s <> '' THEN s WHEN e <> '' THEN e END AS hit FROM m),
x AS (SELECT *, CASE family
    WHEN 'apache' THEN epoch_us(strptime(substr(a, 6, length(a) - 6), '%b %d %H:%M:%S %Y'))
    WHEN 'iso' THEN epoch_us(CAST(i AS TIMESTAMPTZ))
    WHEN 'common_log' THEN epoch_us(strptime(substr(c, 1, 20), '%d/%b/%Y:%H:%M:%S'))
    WHEN 'syslog' THEN epoch_us(strptime('{YEAR} ' || s, '%Y %b %d %H:%M:%S'))
    WHEN 'epoch' THEN CAST(e AS BIGINT) * 1000000 END AS ts_us,
    instr(raw, hit) - 1 AS start_at, CASE WHEN hit IS NULL THEN raw ELSE substr(raw, 1, instr(raw, hit) - 1) || '<TS>' || substr(raw, instr(raw, hit) + length(hit)) END AS stripped FROM t)"""


def _kind(v: str, width: int = 8) -> str:
    kind, most = ("BIGINT", 2**54 - 1) if width == 8 else ("INTEGER", 2**25 - 1)
    return f"""CASE WHEN regexp_matches({v}, '^(0|-?[1-9][0-9]*)$') AND TRY_CAST({v} AS {kind}) IS NOT NULL THEN 'I'
        WHEN strlen({v}) <= 18 AND regexp_matches({v}, '^-?[0-9]*\\.[0-9]+$') AND TRY_CAST(regexp_replace({v}, '[-.]', '', 'g') AS HUGEINT) <= {most} THEN 'F' ELSE 'D' END"""


def _is_var(runs: str = "rs") -> str:
    r = f"{runs}[i]"
    return rf"""(regexp_matches({r}, '^{_WORD}') AND (regexp_matches({r}, '[0-9]')
        OR (i > 1 AND ends_with({runs}[i - 1], '=') AND regexp_matches({r}, '[A-Za-z]')) OR regexp_matches({r}, '^[0-9A-Fa-f]{{2,}}$')))"""


def _runs(source: str, key: str, text: str) -> str:
    return f"""
r AS (SELECT {key}, regexp_extract_all({text}, '{_RUNS}') AS rs FROM {source}),
p AS (SELECT {key}, i, rs[i] AS run, {_is_var()} AS is_var FROM (SELECT {key}, rs, unnest(range(1, len(rs) + 1)) AS i FROM r)),
lt AS (SELECT {key}, string_agg(CASE WHEN is_var THEN CASE {_kind("run")} WHEN 'I' THEN chr(17) WHEN 'F' THEN chr(19) ELSE chr(18) END
       ELSE regexp_replace(run, '([\\\\\\x11\\x12\\x13])', '\\\\\\1', 'g') END, '' ORDER BY i) AS logtype FROM p GROUP BY {key}),
v AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS place, run AS var, {_kind("run")} AS kind, {_kind("run", 4)} AS kind4 FROM p WHERE is_var)"""


_MIXED = f"WITH {_MIXED_TS}, {_runs('x', 'line_number', 'stripped')}"
_DOC_LINES = r"""n AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
d AS (SELECT row_number() OVER (ORDER BY doc_id, place) AS line_number, regexp_replace(s, '\r$', '') AS raw FROM n WHERE regexp_replace(s, '\r$', '') <> '')"""


def _classify(v: str) -> str:
    octets = f"regexp_extract({v}, '^[0-9.]+')"
    return rf"""CASE WHEN regexp_matches({v}, '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$') THEN 'UUID'
        WHEN regexp_matches({v}, '^\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}(:\d+)?$') AND len(list_filter(string_split({octets}, '.'), lambda o: TRY_CAST(o AS INTEGER) > 255)) = 0 THEN 'IPv4'
        WHEN regexp_matches({v}, '^([0-9a-fA-F]{{0,4}}:){{2,7}}[0-9a-fA-F]{{0,4}}$') THEN 'IPv6'
        WHEN regexp_matches({v}, '^-?\d+\.?\d*(ns|us|µs|ms|s|m|h)$') THEN 'Duration'
        WHEN regexp_matches({v}, '^\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}:\d{{2}}') THEN 'Timestamp'
        WHEN regexp_matches({v}, '^(-[+-]?|\+?)([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'Float'
        WHEN regexp_matches({v}, '^[+-]?[0-9]+$') AND TRY_CAST({v} AS BIGINT) IS NOT NULL THEN 'Integer'
        WHEN regexp_matches({v}, '^(0x)?[0-9a-fA-F]{{4,}}$') AND regexp_matches(regexp_replace({v}, '^0x', ''), '[a-fA-F]') THEN 'HexID' ELSE 'String' END"""


def _num(v: str, kind: str) -> str:
    units = " ".join(f"WHEN '{u}' THEN {ms}" for u, ms in variables.UNITS)
    return rf"""CASE WHEN {kind} = 'Duration' THEN CAST(regexp_extract({v}, '^-?\d+\.?\d*') AS DOUBLE) * (CASE regexp_extract({v}, '([a-zµ]+)$') {units} END)
        WHEN {kind} IN ('Integer', 'Float') THEN TRY_CAST({v} AS DOUBLE) END"""


def chain(lines: str, shown: dict[str, str], slots: dict[str, tuple[str, ...]], low: str = "DEBUG") -> str:
    """The tables of an analysis of ``lines`` (line_number, event_type, raw and what the slots' expressions read), whose event
    types have the templates ``shown`` and the variables ``slots``. ``low``: the keyword of debug lines."""
    named = " ".join(f"WHEN '{k}' THEN {t}" for k, t in shown.items())
    return f"""WITH l AS ({lines}),
k AS (SELECT event_type, row_number() OVER (ORDER BY min(line_number)) AS pattern_id, CASE event_type {named} END AS template FROM l GROUP BY event_type),
g AS (SELECT l.*, pattern_id, template, epoch_us(CAST(substr(raw, 1, 24) AS TIMESTAMP)) AS us FROM l JOIN k USING (event_type)),
pc AS (SELECT pattern_id, any_value(template) AS template, count(*) AS count, min(line_number) AS first_line, max(line_number) AS last_line, min(us) AS first_us, max(us) AS last_us FROM g GROUP BY pattern_id),
v0 AS ({" UNION ALL ".join(f"SELECT line_number, pattern_id, {i} AS slot, {e} AS raw FROM g WHERE event_type = '{k}'" for k, es in slots.items() for i, e in enumerate(es))}),
v1 AS (SELECT *, {_classify("raw")} AS var_type FROM v0),
v AS (SELECT *, {_num("raw", "var_type")} AS num FROM v1),
sv AS (SELECT pattern_id, slot, raw AS value, count(*) AS n FROM v GROUP BY ALL),
st AS (SELECT pattern_id, slot, sum(n)::BIGINT AS total, count(*) AS unique_count FROM sv GROUP BY ALL),
tk AS (SELECT * FROM (SELECT pattern_id, slot, value, n, n * 100.0 / total AS pct, row_number() OVER (PARTITION BY pattern_id, slot ORDER BY n DESC, value) AS rank FROM sv JOIN st USING (pattern_id, slot)) WHERE rank <= 10),
mt AS (SELECT pattern_id, slot, arg_max(var_type, n) AS var_type FROM (SELECT pattern_id, slot, var_type, count(*) AS n FROM v GROUP BY ALL) GROUP BY ALL),
en AS (SELECT mt.pattern_id, mt.slot, CASE WHEN var_type = 'String' AND total >= 50 AND unique_count <= 20 AND top3 >= 80 - 1e-9 THEN 'Enum' ELSE var_type END AS var_type, total, unique_count
       FROM mt JOIN st USING (pattern_id, slot) JOIN (SELECT pattern_id, slot, sum(pct) AS top3 FROM tk WHERE rank <= 3 GROUP BY ALL) USING (pattern_id, slot)),
ns AS (SELECT pattern_id, slot, count(*) AS num_count, sum(num) AS sum, avg(num) AS mean, min(num) AS min, max(num) AS max,
       quantile_disc(num, 0.25) AS p25, quantile_disc(num, 0.5) AS p50, quantile_disc(num, 0.75) AS p75, quantile_disc(num, 0.99) AS p99 FROM v WHERE num IS NOT NULL GROUP BY ALL),
b AS (SELECT pattern_id, us // 60000000 AS minute, count(*) AS n FROM g GROUP BY ALL),
sp AS (SELECT min(minute) AS m0, max(minute) AS m1 FROM b),
de AS (SELECT pc.pattern_id, q.minute - m0 AS place, q.minute, coalesce(n, 0) AS n, m1 - m0 + 1 AS len FROM pc, (SELECT *, unnest(range(m0, m1 + 1)) AS minute FROM sp) q LEFT JOIN b ON b.pattern_id = pc.pattern_id AND b.minute = q.minute),
fr AS (SELECT pattern_id, len, sum(CASE WHEN place < floor(len * 0.9) THEN n ELSE 0 END) AS head, sum(CASE WHEN place >= floor(len * 0.9) THEN n ELSE 0 END) AS tail,
       sum(CASE WHEN place < greatest(floor(len * 0.1), 1) THEN n ELSE 0 END) AS start, sum(CASE WHEN place >= greatest(floor(len * 0.1), 1) THEN n ELSE 0 END) AS rest FROM de GROUP BY ALL HAVING len >= 5),
ra AS (SELECT pattern_id, CASE WHEN head > 0 THEN (tail / (len - floor(len * 0.9))) / (head / floor(len * 0.9)) END AS late_ratio,
       CASE WHEN rest > 0 THEN (start / greatest(floor(len * 0.1), 1)) / (rest / (len - greatest(floor(len * 0.1), 1))) END AS early_ratio FROM fr),
an AS (SELECT pattern_id, 'FrequencySpike' AS type, NULL::BIGINT AS var_slot, NULL::BIGINT AS unique_count, least(CASE WHEN late_ratio > 3 THEN late_ratio ELSE early_ratio END / 10, 1.0) AS severity FROM ra WHERE late_ratio > 3 OR early_ratio > 3
       UNION ALL SELECT pattern_id, 'HighErrorRate', NULL, NULL, 0.9 FROM pc WHERE contains(template, 'ERROR')
       UNION ALL SELECT pattern_id, 'LowCardinality', slot, unique_count, 0.6 FROM st JOIN pc USING (pattern_id) WHERE count > 100 AND unique_count < 5
       UNION ALL SELECT pattern_id, 'ClusteredNumeric', slot, NULL, 0.5 FROM ns WHERE num_count > 50 AND mean > 0 AND (max - min) / mean < 0.05
       UNION ALL SELECT pattern_id, 'BimodalDistribution', slot, NULL, 0.4 FROM ns WHERE num_count > 50 AND p25 > 0 AND p75 / p25 > 5),
sc AS (SELECT pattern_id, any_value(template) AS template, any_value(count) AS count, any_value(CASE WHEN contains(template, 'ERROR') THEN 10.0 WHEN contains(template, 'WARN') THEN 5.0 WHEN contains(template, '{low}') THEN 0.1 ELSE 1.0 END) AS w, coalesce(max(severity), 0) AS worst FROM pc LEFT JOIN an USING (pattern_id) GROUP BY pattern_id),
sr AS (SELECT pattern_id, template, count, w::DOUBLE AS keyword_weight, CASE WHEN w >= 10 THEN 'error' WHEN w >= 5 THEN 'warn' WHEN w <= 0.1 THEN 'debug' ELSE 'info' END AS severity, round((count * w * (1 + worst))::DOUBLE, 6) AS score FROM sc),
rk AS (SELECT pattern_id, template, row_number() OVER (ORDER BY count DESC, pattern_id) AS rank FROM pc)
"""


_SERVICE = chain(SERVICE, {k: f"'{t}'" for k, t in _SHOWN.items()}, _SLOTS)
_KEYWORDS = lambda words: " OR ".join(f"list_contains(ts, '{w}')" for w in words)
_PEARSON = "coalesce(CASE WHEN count(*) >= 2 AND count(*) * stddev_pop(a.n) * stddev_pop(b.n) >= 1e-10 THEN covar_pop(a.n, b.n) / (stddev_pop(a.n) * stddev_pop(b.n)) END, 0)"
# labels as the words around the stand-alone wildcards give them
_LABELS = {
    "view": ("id", "duration_ms", "duration", "n4"), "click": ("var1", "f2", "enum3"),
    "error": ("duration_ms", "ip", "n3", "duration"), "purchase": ("n1", "f2", "enum3", "id"), "signup": ("duration",),
}

SQL = {
    "nonempty_lines": f"WITH {_DOC_LINES} SELECT line_number, raw FROM d",
    "ts_extract": f"WITH {_MIXED_TS} SELECT line_number, ts_us, family, start_at, start_at + length(hit) AS end_at FROM x",
    "ts_strip": f"WITH {_MIXED_TS} SELECT line_number, stripped FROM x",
    "ts_family_counts": f"WITH {_MIXED_TS} SELECT coalesce(family, 'none') AS family, count(*) AS n FROM x GROUP BY ALL",
    "clp_logtype": f"{_MIXED} SELECT line_number, logtype FROM lt",
    "clp_variables": f"{_MIXED} SELECT line_number, place, var, kind, kind4 FROM v",
    "clp_int_codec": f"{_MIXED} SELECT DISTINCT var, CAST(var AS BIGINT) AS code, var AS decoded FROM v WHERE kind = 'I'",
    "clp_float_codec": rf"""{_MIXED} SELECT DISTINCT var, CAST(regexp_replace(var, '[-.]', '', 'g') AS BIGINT) * 256 + (length(regexp_replace(var, '[-.]', '', 'g')) - 1) * 16
        + length(regexp_extract(var, '\.([0-9]*)$', 1)) - 1 AS code, var AS decoded FROM v WHERE kind = 'F'""",
    "clp_float_codec4": rf"""{_MIXED} SELECT DISTINCT var, CAST(regexp_replace(var, '[-.]', '', 'g') AS BIGINT) * 64 + (length(regexp_replace(var, '[-.]', '', 'g')) - 1) * 8
        + length(regexp_extract(var, '\.([0-9]*)$', 1)) - 1 AS code, var AS decoded FROM v WHERE kind4 = 'F'""",
    "clp_roundtrip": f"SELECT line_number, raw FROM ({MIXED})",
    "clp_placeholder_counts": f"{_MIXED} SELECT line_number, count(*) FILTER (WHERE is_var AND {_kind('run')} <> 'D') AS encoded, count(*) FILTER (WHERE is_var AND {_kind('run')} = 'D') AS dictionary FROM p GROUP BY line_number",
    "clp_logtype_counts": f"{_MIXED} SELECT logtype, count(*) AS n, min(line_number) AS first_line FROM lt GROUP BY logtype",
    "document_logtypes": f"WITH {_DOC_LINES}, {_runs('d', 'line_number', 'raw')} SELECT logtype, count(*) AS n FROM lt GROUP BY logtype",
    "classify_variables": f"{_MIXED}, c AS (SELECT DISTINCT var, {_classify('var')} AS var_type FROM v) SELECT var, var_type, round({_num('var', 'var_type')}, 6) AS num FROM c",
    "final_templates": f"{_SERVICE} SELECT pattern_id, template FROM pc",
    "template_match": f"{_SERVICE} SELECT line_number, pattern_id FROM g",
    "pattern_span": f"{_SERVICE} SELECT pattern_id, count, first_line, last_line, first_us, last_us FROM pc",
    "global_summary": f"{_SERVICE} SELECT sum(count)::BIGINT AS total_lines, count(*) AS pattern_count, min(first_us) AS first_us, max(last_us) AS last_us, round((1 - count(*) / sum(count)) * 100, 6) AS reduction FROM pc",
    "line_variables": f"{_SERVICE} SELECT line_number, pattern_id, slot::BIGINT AS slot, raw, var_type FROM v",
    "type_majority": f"{_SERVICE} SELECT pattern_id, slot::BIGINT AS slot, var_type FROM mt",
    "enum_reclass": f"{_SERVICE} SELECT pattern_id, slot::BIGINT AS slot, var_type FROM en",
    "numeric_stats": f"{_SERVICE} SELECT pattern_id, slot::BIGINT AS slot, num_count, {', '.join(f'round({c}, 6) AS {c}' for c in ('sum', 'mean', 'min', 'max', 'p25', 'p50', 'p75', 'p99'))} FROM ns",
    "value_topk": f"{_SERVICE} SELECT pattern_id, slot::BIGINT AS slot, value, n, round(pct::DOUBLE, 6) AS pct, rank FROM tk",
    "distinct_counts": f"{_SERVICE} SELECT pattern_id, slot::BIGINT AS slot, unique_count FROM st",
    "minute_buckets": f"{_SERVICE} SELECT pattern_id, minute, n FROM b",
    "dense_buckets": f"{_SERVICE} SELECT pattern_id, count(*) AS minutes, sum(n)::BIGINT AS total, max(n) AS most, sum(n * place)::BIGINT AS moment FROM de GROUP BY pattern_id",
    "frequency_spike_ratios": f"{_SERVICE} SELECT pattern_id, round(late_ratio, 6) AS late_ratio, round(early_ratio, 6) AS early_ratio FROM ra",
    "anomaly_rows": f"{_SERVICE} SELECT pattern_id, type, var_slot, unique_count, round(severity::DOUBLE, 6) AS severity FROM an",
    "severity_score": f"{_SERVICE} SELECT pattern_id, count, keyword_weight, severity, score FROM sr",
    "keyword_weight": rf"""WITH {_DOC_LINES}, w AS (SELECT raw, string_split_regex(upper(CASE WHEN strlen(raw) = length(raw) THEN left(raw, 100)
            ELSE left(raw, len(list_filter(range(1, 101), lambda n: strlen(left(raw, n)) <= 100))::BIGINT) END), '[\s\[\](){{}}=:;,."''<>]+') AS ts FROM d)
        SELECT CASE WHEN {_KEYWORDS(severity.HIGH)} THEN 10.0 WHEN {_KEYWORDS(severity.MIDDLE)} THEN 5.0 WHEN {_KEYWORDS(severity.LOW)} THEN 0.1 ELSE 1.0 END::DOUBLE AS w, count(*) AS n,
            count(*) FILTER (WHERE {_KEYWORDS(severity.ERROR_TOKENS)}) AS errors, count(*) FILTER (WHERE regexp_matches(upper(raw), 'ERROR|FATAL|PANIC')) AS mentions FROM w GROUP BY 1""",
    "topn_patterns": f"{_SERVICE} SELECT pattern_id, template, count, round(count * 100 / (SELECT sum(count) FROM pc), 6) AS pct FROM pc ORDER BY count DESC, pattern_id LIMIT 3",
    "llm_sections": f"""{_SERVICE} SELECT * FROM (SELECT 'critical' AS section, pattern_id, score FROM sr WHERE severity IN ('error', 'warn') ORDER BY score DESC, count DESC, pattern_id LIMIT 2)
        UNION ALL SELECT * FROM (SELECT 'high', pattern_id, score FROM sr WHERE severity NOT IN ('error', 'warn') ORDER BY count DESC, pattern_id LIMIT 2)""",
    "temporal_pairs": f"""{_SERVICE} SELECT a.pattern_id AS pattern_a, b.pattern_id AS pattern_b, round(abs({_PEARSON}), 6) AS strength
        FROM de a JOIN rk x ON x.pattern_id = a.pattern_id JOIN de b ON a.place = b.place JOIN rk y ON y.pattern_id = b.pattern_id AND x.rank < y.rank GROUP BY ALL HAVING count(*) >= 3""",
    "shared_variables": f"""{_SERVICE}, t AS (SELECT tk.*, en.var_type, rank_p, count(*) OVER (PARTITION BY tk.pattern_id, tk.slot) AS size FROM tk JOIN en USING (pattern_id, slot) JOIN (SELECT pattern_id, rank AS rank_p FROM rk) USING (pattern_id)),
        h AS (SELECT a.pattern_id AS pattern_a, b.pattern_id AS pattern_b, a.slot AS sa, b.slot AS sb, any_value(a.var_type) AS var_type
              FROM t a JOIN t b ON a.value = b.value AND a.var_type = b.var_type AND a.rank_p < b.rank_p GROUP BY ALL HAVING count(*) / least(any_value(a.size), any_value(b.size)) > 0.05)
        SELECT pattern_a, pattern_b, 'share ' || arg_min(var_type, sa * 1000 + sb) || ' values' AS description, 0.8::DOUBLE AS strength FROM h GROUP BY ALL""",
    "error_cascade": f"""{_SERVICE}, h AS (SELECT a.pattern_id AS pattern_a, b.pattern_id AS pattern_b, lag, {_PEARSON} AS r
              FROM (SELECT *, unnest([1, 2, 3]) AS lag FROM de) a JOIN rk x ON x.pattern_id = a.pattern_id AND NOT contains(x.template, 'ERROR')
              JOIN de b ON b.place = a.place + lag JOIN rk y ON y.pattern_id = b.pattern_id AND contains(y.template, 'ERROR') GROUP BY ALL)
        SELECT pattern_a, pattern_b, 'precedes error by ~' || min(lag) || 'min' AS description, 0.9::DOUBLE AS strength FROM h WHERE r > -1 AND (SELECT max(len) FROM de) >= 6 GROUP BY pattern_a, pattern_b""",
    "infer_labels": f"{_SERVICE}, n(event_type, slot, label) AS (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {i}, {chr(39)}{x}{chr(39)})' for k, xs in _LABELS.items() for i, x in enumerate(xs))}) SELECT pattern_id, slot::BIGINT AS slot, label FROM n JOIN k USING (event_type)",
    "truncate_tokens": r"""WITH w AS (SELECT page_id, list_filter(string_split_regex(html, '[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda t: t <> '') AS ws FROM pages)
        SELECT page_id, array_to_string(list_transform(ws, lambda t: CASE WHEN strlen(t) <= 50 THEN t
            ELSE left(t, len(list_filter(range(1, 21), lambda n: strlen(left(t, n)) <= 20))::BIGINT) || '...' || right(t, len(list_filter(range(1, 11), lambda n: strlen(right(t, n)) <= 10))::BIGINT) END), ' ') AS short FROM w""",
}


def queries() -> dict:
    fs = (
        nonempty_lines, ts_extract, ts_strip, ts_family_counts, clp_logtype, clp_variables, clp_int_codec, clp_float_codec, clp_float_codec4, clp_roundtrip,
        clp_placeholder_counts, clp_logtype_counts, document_logtypes, classify_variables, drain_clusters, drain_documents, final_templates, template_match,
        pattern_span, global_summary, line_variables, type_majority, enum_reclass, numeric_stats, value_topk, distinct_counts, approx_distinct, approx_quantiles,
        minute_buckets, dense_buckets, reservoir_examples, frequency_spike_ratios, anomaly_rows, severity_score, keyword_weight, topn_patterns, llm_sections,
        temporal_pairs, shared_variables, error_cascade, correlation_report, infer_labels, truncate_tokens, decompose_full, decompose_json,
    )
    return {f.__name__: _alone(f) for f in fs}


def _alone(query):
    """The query with its result staged, and what was staged for it deleted."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return finished(lambda: query(spark, sf_dir), query.__name__)

    return run


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
