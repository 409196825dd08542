"""Timestamps in log lines as column expressions.

Families are tried in a fixed order, not by place in the line; of each only its leftmost match counts, and
one that does not parse (13th month, wrong weekday) leaves the line to the next family. Results do not
depend on the session's time zone.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the five shapes
APACHE = r"\[[A-Z][a-z]{2} [A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2} \d{4}\]"
ISO = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?"
COMMON_LOG = r"\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}"
SYSLOG = r"[A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2}"
EPOCH = r"\b1[0-9]{9}(?:[0-9]{3})?\b"
PLACEHOLDER = "<TS>"
WEEKDAYS = "ThuFriSatSunMonTueWed"  # day 0 of the epoch was a Thursday


def _utc(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(F.concat(F.regexp_replace(text, " +", " "), F.lit(" +0000")), F.lit(f"{pattern} Z"))


def _apache(m: Column) -> Column:
    ts = _utc(m.substr(F.lit(6), F.length(m) - 6), "MMM d HH:mm:ss yyyy")
    day = F.pmod(F.floor(F.unix_seconds(ts) / 86400), F.lit(7)).cast("int")
    return F.when(F.lit(WEEKDAYS).substr(day * 3 + 1, F.lit(3)) == m.substr(2, 3), ts)


def _iso(m: Column) -> Column:
    zone = F.regexp_extract(m, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    zone = F.when(F.length(m) > 19, zone).otherwise("")
    bare = m.substr(F.lit(1), F.length(m) - F.length(zone))
    zone = F.when(zone == "", "Z").otherwise(F.regexp_replace(zone, r"^([+-]\d{2}):?(\d{2})$", "$1:$2"))
    return F.concat(F.replace(bare, F.lit(" "), F.lit("T")), zone).try_cast("timestamp")


def _epoch(m: Column) -> Column:
    n = m.try_cast("bigint")
    return F.when(F.length(m) == 10, F.timestamp_millis(n * 1000)).otherwise(F.timestamp_millis(n))


def families(default_year: int | None = None) -> list[tuple[str, str, object]]:
    """(name, regular expression, parser of the match) in order. Syslog has no year: ``default_year``, else this one."""
    year = default_year or datetime.now(timezone.utc).year
    syslog = lambda m: _utc(F.concat(F.lit(f"{year} "), m), "yyyy MMM d HH:mm:ss")
    common = lambda m: F.try_to_timestamp(m, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    return [("apache", APACHE, _apache), ("iso", ISO, _iso), ("common_log", COMMON_LOG, common), ("syslog", SYSLOG, syslog), ("epoch", EPOCH, _epoch)]


def extract_timestamp(line: Column, default_year: int | None = None) -> Column:
    """Struct of ts, family, start, end (character offsets, end exclusive); null without a timestamp."""
    found = []
    for name, regex, parse in families(default_year):
        at = F.regexp_instr(line, F.lit(regex))
        match = F.regexp_extract(line, regex, 0)
        ts = parse(match)
        span = F.struct(ts.alias("ts"), F.lit(name).alias("family"), (at - 1).alias("start"), (at - 1 + F.length(match)).alias("end"))
        found.append(F.when((at > 0) & ts.isNotNull(), span))
    return F.when(line.rlike("[0-9]"), F.coalesce(*found))  # one look at a line without digits, not ten


def strip_timestamp(line: Column, match: Column) -> Column:
    """The line with the matched span replaced by ``<TS>``; the line itself where there is none."""
    cut = F.concat(line.substr(F.lit(1), match["start"]), F.lit(PLACEHOLDER), line.substr(match["end"] + 1, F.length(line)))
    return F.when(match.isNotNull(), cut).otherwise(line)


def minute(ts: Column) -> Column:
    """Minutes since the epoch."""
    return F.floor(F.unix_seconds(ts) / 60).cast("long")
