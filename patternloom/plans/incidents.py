"""Queries over lines with everything that is rare in the others: bursts, values of two modes, patterns that share values,
errors that follow warnings, backslashes, UUIDs, IPv6 addresses and second timestamps; and SQL that states them.

Lines are made from ``events`` by one expression that both engines understand. A kind's lines (event_id % 8) have a number of
tokens of their own, so that SQL can name templates and variables without mining them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clp
from ..operators import anomalies, scoring, stats
from .catalog import _PEARSON, _alone, _round, _slots, chain
from .decompose import Decomposition

_TEXT = lambda e: f"CAST(CAST({e} AS BIGINT) AS STRING)"
#: Minute of each kind's lines: uniform, late, early and uneven ones; errors come two minutes after warnings.
_MINUTES = (
    "j % 100", "CASE WHEN j % 50 = 0 THEN 3 ELSE 92 + j % 8 END", "CASE WHEN j % 50 = 0 THEN 60 ELSE j % 9 END", "(j * j) % 89",
    "12 + 20 * (j % 4)", "10 + 20 * (j % 4)", "10 + 20 * (j % 4)", "j % 97",
)
_UNEVEN = "j % 2 = 0"
_VOLUME = f"'vol' || {_TEXT('j % 6')}"
#: Variables of each kind's lines, in order.
_SLOTS = {
    "beat": (f"'550e8400-e29b-41d4-a716-' || lpad({_TEXT('event_id')}, 12, '0')", f"CASE WHEN {_UNEVEN} THEN 'fe80::1:22' ELSE 'fe80::a1b:9' END", f"CASE WHEN {_UNEVEN} THEN '2024-01-15T14:22:07Z' ELSE '2024-01-15T14:05:07Z' END"),
    "queue": (_TEXT("j"),),
    "warmup": (_TEXT("j * 3"),),
    "served": (f"{_TEXT(f'CASE WHEN {_UNEVEN} THEN 10 + j % 5 ELSE 900 + j % 7 END')} || 'ms'",),
    "failure": (_VOLUME, _TEXT("j % 11")),
    "latency": (_VOLUME,),
    "opened": (_TEXT("j"),),
    "span": (f"'a' || lpad({_TEXT('event_id')}, 8, '0') || 'f'",),
}
_FOLDER = "|| chr(92) || 'temp' || chr(92) ||"
_SHAPES = {
    "beat": "INFO beat {} {} {}", "queue": "WARN queue depth {} over limit", "warmup": "INFO warmup of cache with {} keys", "served": "INFO served in {}",
    "failure": "ERROR disk failure on {} code {} after last", "latency": "WARN disk latency high on {} right now",
    "opened": "INFO opened C:{}", "span": "TRACE span {} closed by worker pool at its own end",
}


def _body(kind: str) -> str:
    out = "'" + _SHAPES[kind].replace("{}", "' || ({}) || '").format(*_SLOTS[kind]) + "'"
    return out.replace("C:' ||", f"C:' {_FOLDER}")


def _shown(kind: str) -> str:
    """SQL for the template."""
    return f"'<TS> {_SHAPES[kind]}'".replace("{}", "<*>").replace("C:<*>", f"C:' {_FOLDER} '<*>")


_KIND = "CASE CAST(event_id % 8 AS INT) " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_SHAPES)) + " END"
_MINUTE = "CAST(CASE CAST(event_id % 8 AS INT) " + " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(_MINUTES)) + " END AS BIGINT)"
_TWO = lambda e: f"lpad({_TEXT(e)}, 2, '0')"
_PREFIX = f"'2024-03-01T' || {_TWO('floor(place / 60)')} || ':' || {_TWO('place % 60')} || ':' || {_TWO('event_id % 60')} || '.000Z '"
LINES = f"""SELECT event_id + 1 AS line_number, event_type, event_id, j, {_PREFIX} || CASE event_type {" ".join(f"WHEN '{k}' THEN {_body(k)}" for k in _SHAPES)} END AS raw
    FROM (SELECT event_id, j, {_KIND} AS event_type, {_MINUTE} AS place FROM (SELECT event_id, CAST(floor(event_id / 8) AS BIGINT) AS j FROM events))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(LINES.replace("FROM events", "FROM {events}"), events=events).select("line_number", "raw")


def _analysis(spark: SparkSession, sf_dir: str, **how) -> Decomposition:
    return Decomposition(lines(spark, sf_dir), **how)


def incident_templates(spark, sf_dir):
    return _analysis(spark, sf_dir).counted.select("pattern_id", "template", "count")


def incident_variables(spark, sf_dir):
    rows = _analysis(spark, sf_dir).variables
    return rows.select("line_number", "pattern_id", F.col("slot").cast("long").alias("slot"), "raw", "var_type", F.round("num", 6).alias("num"))


def incident_escapes(spark, sf_dir):
    """Lines with backslashes: their logtype, and the line decoded from it."""
    m = F.col("m")
    rows = lines(spark, sf_dir).where(F.contains("raw", F.lit("\\"))).withColumn("m", clp.encode_message(F.col("raw")))
    return rows.select("line_number", m["logtype"].alias("logtype"), clp.decode_message(m["logtype"], m["encoded_vars"], m["dictionary_vars"]).alias("raw"))


def incident_anomalies(spark, sf_dir):
    rows = _round(_analysis(spark, sf_dir).anomalies, "severity")
    return rows.select("pattern_id", "type", F.col("var_slot").cast("long").alias("var_slot"), "unique_count", "severity")


def incident_by_pattern(spark, sf_dir):
    """Patterns with anomalies, the most severe first, and their types, the most severe first."""
    rows = anomalies.by_pattern(_analysis(spark, sf_dir).anomalies)
    kinds = F.array_join(F.transform("anomalies", lambda a: a["type"]), ",")
    return _placed(_round(rows.select("pattern_id", "max_severity", kinds.alias("types")), "max_severity"))


def _placed(rows: DataFrame) -> DataFrame:
    """A short ordered report with each row's place in it."""
    return rows.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)


def incident_scores(spark, sf_dir):
    return _round(_analysis(spark, sf_dir).patterns, "score").select("pattern_id", "count", "keyword_weight", "severity", "score")


def incident_critical(spark, sf_dir):
    rows = scoring.critical_patterns(_analysis(spark, sf_dir).patterns, 3)
    return _round(rows, "score").select("pattern_id", "severity", "score")


def incident_correlations(spark, sf_dir):
    """All correlations over their thresholds, in the order of the report."""
    rows = _analysis(spark, sf_dir).correlations
    return _placed(_round(rows, "strength").select("pattern_a", "pattern_b", "correlation_type", "description", "strength"))


def incident_slots(spark, sf_dir):
    return _slots(_analysis(spark, sf_dir).slots, "var_type", "total", "unique_count", "label")


def _close(share: str, q: float) -> Column:
    """Whether a value with a share of smaller values and one of values up to it can be the quantile, give or take a hundredth."""
    return (F.col(f"{share}_under") <= q + 0.01) & (F.col(f"{share}_upto") >= q - 0.01)


def incident_approximate(spark, sf_dir):
    """Sketched distinct counts and quantiles: whether each is near enough the exact one."""
    v = _analysis(spark, sf_dir).variables
    exact, sketch = stats.distinct_counts(v), stats.distinct_counts(v, True).withColumnRenamed("unique_count", "about")
    counts = exact.join(sketch, stats.SLOT).select(*stats.SLOT, "unique_count", (F.abs(F.col("about") - F.col("unique_count")) <= 1 + 0.02 * F.col("unique_count")).alias("count_close"))
    names = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    each = v.where("num IS NOT NULL").join(stats.numeric_stats(v, True).select(*stats.SLOT, *names), stats.SLOT)
    shares = each.groupBy(*stats.SLOT).agg(*[F.avg((F.col("num") < F.col(n)).cast("int")).alias(f"{n}_under") for n in names], *[F.avg((F.col("num") <= F.col(n)).cast("int")).alias(f"{n}_upto") for n in names])
    near = shares.select(*stats.SLOT, *[_close(n, q).alias(f"{n}_close") for n, q in names.items()])
    return _slots(counts.join(near, stats.SLOT, "left"), "unique_count", "count_close", *[f"{n}_close" for n in names])


_CHAIN = chain(LINES, {k: _shown(k) for k in _SHAPES}, _SLOTS, "TRACE")
_LAGGED = f"""h AS (SELECT x.pattern_id AS pattern_a, y.pattern_id AS pattern_b, any_value(x.rank) AS rank_a, any_value(y.rank) AS rank_b, lag, any_value(contains(x.template, 'ERROR')) AS error_a, any_value(contains(y.template, 'ERROR')) AS error_b, {_PEARSON} AS r
    FROM (SELECT *, unnest([0, 1, 2, 3]) AS lag FROM de) a JOIN rk x ON x.pattern_id = a.pattern_id JOIN de b ON b.place = a.place + lag JOIN rk y ON y.pattern_id = b.pattern_id AND x.rank <> y.rank GROUP BY x.pattern_id, y.pattern_id, lag)"""
_SHARED = """t AS (SELECT tk.*, en.var_type, rank_p, count(*) OVER (PARTITION BY tk.pattern_id, tk.slot) AS size FROM tk JOIN en USING (pattern_id, slot) JOIN (SELECT pattern_id, rank AS rank_p FROM rk) USING (pattern_id)),
    s AS (SELECT a.pattern_id AS pattern_a, b.pattern_id AS pattern_b, a.slot AS sa, b.slot AS sb, any_value(a.var_type) AS var_type
          FROM t a JOIN t b ON a.value = b.value AND a.var_type = b.var_type AND a.rank_p < b.rank_p GROUP BY ALL HAVING count(*) / least(any_value(a.size), any_value(b.size)) > 0.5)"""
# labels as the words around the stand-alone wildcards give them
_LABELS = {
    "beat": ("uuid", "ip", "timestamp"), "queue": ("n1",), "warmup": ("n1",), "served": ("duration",), "failure": ("var1", "code"), "latency": ("var1",), "opened": ("n1",), "span": ("id",),
}

SQL = {
    "incident_templates": f"{_CHAIN} SELECT pattern_id, template, count FROM pc",
    "incident_variables": f"{_CHAIN} SELECT line_number, pattern_id, slot::BIGINT AS slot, raw, var_type, round(num, 6) AS num FROM v",
    "incident_escapes": f"""WITH l AS ({LINES}) SELECT line_number, chr(18) || ':' || chr(17) || ':' || chr(18) || ' INFO opened C:' || repeat(chr(92), 2) || 'temp' || repeat(chr(92), 2) || chr(17) AS logtype, raw FROM l WHERE contains(raw, chr(92))""",
    "incident_anomalies": f"{_CHAIN} SELECT pattern_id, type, var_slot, unique_count, round(severity::DOUBLE, 6) AS severity FROM an",
    "incident_by_pattern": f"{_CHAIN} SELECT pattern_id, round(max(severity)::DOUBLE, 6) AS max_severity, string_agg(type, ',' ORDER BY severity DESC, type, var_slot) AS types, row_number() OVER (ORDER BY max(severity) DESC, pattern_id) AS place FROM an GROUP BY pattern_id",
    "incident_scores": f"{_CHAIN} SELECT pattern_id, count, keyword_weight, severity, score FROM sr",
    "incident_critical": f"{_CHAIN} SELECT pattern_id, severity, score FROM sr WHERE severity IN ('error', 'warn') ORDER BY score DESC, count DESC, pattern_id LIMIT 3",
    "incident_correlations": f"""{_CHAIN}, {_LAGGED}, {_SHARED}
        , f AS (SELECT 0 AS kind, pattern_a, pattern_b, 'TemporalCooccurrence' AS correlation_type, printf('spike together (r=%.2f)', r) AS description, round(abs(r), 6) AS strength FROM h WHERE lag = 0 AND rank_a < rank_b AND abs(r) > 0.7
        UNION ALL SELECT 1, pattern_a, pattern_b, 'SharedVariable', 'share ' || arg_min(var_type, sa * 1000 + sb) || ' values', 0.8 FROM s GROUP BY pattern_a, pattern_b
        UNION ALL SELECT 2, pattern_a, pattern_b, 'ErrorCascade', 'precedes error by ~' || min(lag) || 'min', 0.9 FROM h WHERE lag > 0 AND r > 0.7 AND error_b AND NOT error_a GROUP BY pattern_a, pattern_b)
        SELECT pattern_a, pattern_b, correlation_type, description, strength, row_number() OVER (ORDER BY strength DESC, kind, x.rank, y.rank) AS place
        FROM f JOIN rk x ON x.pattern_id = pattern_a JOIN rk y ON y.pattern_id = pattern_b""",
    "incident_slots": f"{_CHAIN}, n(event_type, slot, label) AS (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {i}, {chr(39)}{x}{chr(39)})' for k, xs in _LABELS.items() for i, x in enumerate(xs))}) SELECT pattern_id, slot::BIGINT AS slot, var_type, total, unique_count, label FROM n JOIN k USING (event_type) JOIN en USING (pattern_id, slot)",
    "incident_approximate": f"""{_CHAIN} SELECT pattern_id, slot::BIGINT AS slot, unique_count, true AS count_close, {', '.join(f'CASE WHEN num_count > 0 THEN true END AS {p}_close' for p in ('p25', 'p50', 'p75', 'p99'))}
        FROM st LEFT JOIN ns USING (pattern_id, slot)""",
}


def queries() -> dict:
    fs = (incident_templates, incident_variables, incident_escapes, incident_anomalies, incident_by_pattern, incident_scores, incident_critical, incident_correlations, incident_slots, incident_approximate)
    return {f.__name__: _alone(f) for f in fs}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
