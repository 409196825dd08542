"""Live counts and live clustering."""

from patternloom.sources.lines import stream_log_files
from patternloom.streaming.live import live_templates, minute_counts, parse_stream


def drain(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_live(spark, tmp_path, sample_lines):
    for i in range(2):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        (folder / f"{i}.log").write_text("\n".join(sample_lines[10 * i : 10 * i + 10]) + "\n")
    parsed = parse_stream(stream_log_files(spark, str(tmp_path / "in")), 2024)
    drain(minute_counts(parsed).writeStream.format("memory").queryName("minutes").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).start())
    assert sum(r.n for r in spark.table("minutes").collect()) == 20
    drain(live_templates(parsed).writeStream.format("memory").queryName("live").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).start())
    last = {}
    for r in spark.table("live").collect():
        last[r.token_count, r.cluster] = max(last.get((r.token_count, r.cluster), (0, 0)), (r.version, r.n))
    assert sorted(n for _, n in last.values()) == [3, 3, 14]
