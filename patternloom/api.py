"""Entry points: analyse text, files or tables, and render the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans.decompose import decompose
from .reports.model import Options, gather
from .reports.render import render
from .sources.lines import lines_of_text, read_log_files


def report(lines: DataFrame, options: Options, **how) -> str:
    """Render an analysis of ``lines`` (line_number, raw)."""
    d = decompose(lines, context=options.context, **how)
    try:
        return render(gather(d, options), options)
    finally:
        d.close()


def _context(format: str, context: int) -> int:
    return 2 if format == "llm" and context == 0 else context


def analyze_logs(input: str, format: str = "human", top_n: int = 20, context_lines: int = 0, spark: SparkSession | None = None, **how) -> str:
    """Report on the lines of a string; unknown formats are human."""
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return report(lines_of_text(spark, input), Options(top_n, _context(format, context_lines), True, False, format), **how)


def analyze_logs_json(input: str, top_n: int = 20, context_lines: int = 0, spark: SparkSession | None = None, **how) -> str:
    return analyze_logs(input, "json", top_n, context_lines, spark, **how)


def analyze_files(spark: SparkSession, *paths: str, options: Options = Options(), **how) -> str:
    """Report on text files."""
    return report(read_log_files(spark, *paths), options, **how)
