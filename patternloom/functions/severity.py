"""Keywords in templates: weight, severity, error test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import let

# fixed values: keyword weights
HIGH = ("ERROR", "FATAL", "PANIC", "CRIT", "CRITICAL", "SEGFAULT", "SIGKILL", "SIGSEGV", "OOM", "CRASH", "ABORT", "CORRUPT")
MIDDLE = (
    "WARN", "WARNING", "FAIL", "FAILED", "FAILURE", "TIMEOUT", "TIMED_OUT", "REFUSED", "DENIED", "REJECTED", "EXCEPTION", "DEADLOCK", "OVERFLOW",
    "EXHAUSTED", "UNAVAILABLE", "UNREACHABLE", "UNAUTHORIZED", "FORBIDDEN", "RETRY", "RETRYING", "BACKOFF",
)
LOW = ("DEBUG", "TRACE")
WEIGHTS = ((HIGH, 10.0), (MIDDLE, 5.0), (LOW, 0.1))
ERROR_TOKENS = ("ERROR", "FATAL", "CRIT", "PANIC")
PREFIX_BYTES = 100
DELIMITERS = r"""[\s\[\](){}=:;,."'<>]+"""


def prefix(template: Column) -> Column:
    """The first 100 bytes, back to the last whole character."""
    chars = F.filter(F.sequence(F.lit(1), F.lit(PREFIX_BYTES)), lambda n: F.octet_length(template.substr(F.lit(1), n)) <= PREFIX_BYTES)
    whole = template.substr(F.lit(1), F.array_max(chars))
    return F.when(F.octet_length(template) == F.char_length(template), F.left(template, F.lit(PREFIX_BYTES))).otherwise(whole)


def prefix_tokens(template: Column) -> Column:
    return F.split(F.upper(prefix(template)), DELIMITERS)


def _words(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def keyword_weight(template: Column) -> Column:
    """The largest weight of a keyword among the tokens of the template's beginning; 1.0 without any."""
    def weigh(found: Column) -> Column:
        out = F
        for words, weight in WEIGHTS:
            out = out.when(F.arrays_overlap(found, _words(words)), weight)
        return out.otherwise(1.0)

    return let(prefix_tokens(template), weigh)


def severity(weight: Column) -> Column:
    return F.when(weight >= 10, "error").when(weight >= 5, "warn").when(weight <= 0.1, "debug").otherwise("info")


def has_error_token(template: Column) -> Column:
    """An error word as a token of the template's beginning (the anomaly rule)."""
    return F.arrays_overlap(prefix_tokens(template), _words(ERROR_TOKENS))


def mentions_error(template: Column) -> Column:
    """An error word anywhere (the correlation rule)."""
    return F.upper(template).rlike("ERROR|FATAL|PANIC")
