"""The three formats over the sample, the API and the command line."""

import json

import pytest

from patternloom.__main__ import main, options_of, parser
from patternloom.api import analyze_logs, analyze_logs_json
from patternloom.plans.decompose import Decomposition
from patternloom.reports.model import Options, gather
from patternloom.reports.render import count_text, render, short_token, tenth


@pytest.fixture(scope="module")
def report(spark, sample_lines):
    d = Decomposition(spark.createDataFrame([(i + 1, t) for i, t in enumerate(sample_lines)], "line_number long, raw string"), context=2)
    found = gather(d, Options(context=2))
    d.close()
    return found


def test_json(report):
    doc = json.loads(render(report, Options(context=2, format="json")))
    assert doc["summary"] == {"total_lines": 20, "pattern_count": 3, "patterns_shown": 3, "patterns_omitted": 0, "time_range": {"start": "2024-01-15T14:22:01.100+00:00", "end": "2024-01-15T14:22:04.500+00:00"}}
    first, second, third = doc["patterns"]
    assert (first["template"], first["count"], first["frequency_pct"], first["severity"], first["score"]) == ("<TS> INFO [<*>] Request from <*> completed in <*> status=<*>", 14, 70.0, "info", 14.0)
    assert [v["type"] for v in first["variables"]] == ["HexID", "IPv4", "Duration", "Integer"]
    assert [v["label"] for v in first["variables"]] == ["id", "duration_ms", "duration", "n4"]
    assert [v["unique_count"] for v in first["variables"]][:2] == [14, 6]
    assert first["variables"][2]["numeric"] == {"mean": 188.5, "p50": 41.0, "p99": 1847.0, "min": 28.0, "max": 1847.0}
    assert first["variables"][1]["top_values"][0] == {"value": "10.0.1.15", "count": 6, "pct": 42.9}
    assert {second["template"], third["template"]} == {"<TS> WARN [<*>] Connection pool exhausted, waiting <*>", "<TS> ERROR [<*>] Timeout connecting to <*>:<*> after <*>"}
    error = second if second["severity"] == "error" else third
    assert (error["score"], [v["label"] for v in error["variables"]]) == (57.0, ["duration_ms", "ip", "n3", "duration"])
    assert all(len(p["example_lines"]) <= 2 for p in doc["patterns"])


def test_human(report):
    text = render(report, Options(no_banner=True, context=2))
    assert text.startswith('Pattern #1 (14 occurrences, 70.0%)\n  "<TS> INFO [<*>]')
    assert "    Duration: mean=188, p50=41, p99=1847, min=28, max=1847\n" in text or "    Duration: mean=189" in text
    assert "Pattern #2 [WARN] (3 occurrences, 15.0%)" in text or "Pattern #2 [ERROR] (3 occurrences, 15.0%)" in text
    assert "  Examples:\n    | 2024" in text
    with_banner = render(report, Options(no_color=False))
    assert "20 lines -> 3 patterns (85.0% reduction)" in with_banner and "  Time range: 14:22:01 UTC -> 14:22:04 UTC\n" in with_banner and "\x1b[1;31m[ERROR]\x1b[0m" in with_banner


def test_llm(report):
    text = render(report, Options(format="llm", context=2))
    assert text.startswith("## Log Analysis: 20 lines -> 3 patterns, time span: 14:22:01-14:22:04 UTC\n\n### Critical Patterns (errors, warnings): 2\n1. [ERROR, 15.0%, 3 lines]")
    assert '\n### High-Volume Patterns (top 1 by count):\n1. [70.0%] "<TS> INFO [<*>] Request from {id} completed in {duration_ms} status=<*>"    (14 lines)\n   e.g. 2024' in text


def test_api(spark):
    text = "INFO request completed in 45ms\nINFO request completed in 32ms\n"
    doc = json.loads(analyze_logs_json(text, 1, 0, spark))
    assert len(doc["patterns"]) == 1 and doc["patterns"][0]["count"] == 2 and "time_range" not in doc["summary"]
    flat = analyze_logs(text, "llm", 20, 0, spark)
    assert "### Patterns (1, 100.0% of lines):\n1. [100.0%, 2 lines] INFO request completed in {duration}\n   duration: mean=38 p50=32 p99=45 min=32 max=45\n   e.g. INFO" in flat
    assert json.loads(analyze_logs_json("", 5, 0, spark))["summary"]["total_lines"] == 0
    assert "Pattern #1" in analyze_logs(text, "no such format", 20, 0, spark)


def test_command_line(spark, tmp_path, sample_lines, capsys):
    f = tmp_path / "x.log"
    f.write_text("\n".join(sample_lines) + "\n")
    assert main([str(f), "--json", "--top", "1", "-q"]) == 0
    out = capsys.readouterr()
    assert len(json.loads(out.out)["patterns"]) == 1 and out.err == ""
    assert options_of(parser().parse_args(["--llm"])) == Options(20, 2, False, False, "llm")
    assert options_of(parser().parse_args(["--llm", "--json"])).format == "json"


def test_small_helpers():
    assert [count_text(n) for n in (999, 1000, 1234567)] == ["999", "1,000", "1.2M"]
    assert tenth(0.25) == 0.3 and short_token("x" * 51) == "x" * 20 + "..." + "x" * 10
