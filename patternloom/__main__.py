"""Command line: ``python -m patternloom [FILE]``; standard input without a file or with ``-``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .api import _context
from .plans.decompose import decompose
from .reports.model import Options, gather
from .reports.render import render
from .sources.lines import read_log_files, read_stream


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("patternloom", description="Compress raw log lines into structural patterns")
    p.add_argument("file", nargs="?", help="log file (standard input without one, or with -)")
    p.add_argument("--human", action="store_true", help="human-readable report (default)")
    p.add_argument("--llm", action="store_true", help="compact markdown report")
    p.add_argument("--json", action="store_true", help="JSON report")
    p.add_argument("--top", type=int, default=20, help="patterns to show")
    p.add_argument("--context", type=int, default=0, help="example lines for each pattern")
    p.add_argument("--no-color", action="store_true")
    p.add_argument("--no-banner", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true", help="nothing on standard error")
    p.add_argument("--mode", choices=("replay", "distinct"), default="replay", help="clustering over all lines or over distinct logtypes")
    p.add_argument("--master", default="local[*]")
    return p


def options_of(args: argparse.Namespace) -> Options:
    """JSON goes before markdown, and markdown before human."""
    form = "json" if args.json else "llm" if args.llm else "human"
    context = _context("llm" if args.llm else form, args.context)
    return Options(args.top, context, args.no_color, args.no_banner, form)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    options = options_of(args)
    spark = SparkSession.builder.master(args.master).appName("patternloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if args.file in (None, "-"):
        lines = read_stream(spark, sys.stdin.buffer)
    else:
        lines = read_log_files(spark, args.file)
    d = decompose(lines, mode=args.mode, context=options.context)
    found = gather(d, options)
    if not args.quiet:
        print(f"Processed {found.total_lines} lines -> {found.pattern_count} patterns", file=sys.stderr)
    sys.stdout.write(render(found, options))
    d.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
