"""What a report shows, gathered: a bounded number of patterns with their slots, values and examples."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..operators import scoring
from ..plans.decompose import Decomposition

HIGH_VOLUME = 5


@dataclass
class Options:
    top: int = 20
    context: int = 0
    no_color: bool = True
    no_banner: bool = False
    format: str = "human"


@dataclass
class Slot:
    var_type: str
    label: str
    unique: int
    numeric: dict | None
    top: list[tuple[str, int, float]] = field(default_factory=list)


@dataclass
class Pattern:
    id: int
    template: str
    count: int
    score: float
    severity: str
    slots: list[Slot] = field(default_factory=list)
    examples: list[str] = field(default_factory=list)

    @property
    def critical(self) -> bool:
        return self.severity in ("error", "warn")


@dataclass
class Report:
    total_lines: int
    pattern_count: int
    first_ts: datetime | None
    last_ts: datetime | None
    by_count: list[Pattern]
    critical: list[Pattern]
    high_volume: list[Pattern]


def gather(d: Decomposition, options: Options) -> Report:
    """Collects top-N rows only."""
    s = d.summary.select("total_lines", "pattern_count", F.unix_micros("first_ts"), F.unix_micros("last_ts")).first()
    day = lambda us: None if us is None else datetime.fromtimestamp(us // 1_000_000, tz=timezone.utc).replace(microsecond=us % 1_000_000)
    lists = [scoring.top_patterns(d.patterns, options.top), scoring.critical_patterns(d.patterns, options.top), scoring.high_volume_patterns(d.patterns, HIGH_VOLUME)]
    lists = [x.select("pattern_id", "template", "count", "score", "severity").collect() for x in lists]
    wanted = sorted({r.pattern_id for rows in lists for r in rows})
    made = {r.pattern_id: Pattern(r.pattern_id, r.template, r["count"], r.score, r.severity) for rows in lists for r in rows}
    chosen = F.col("pattern_id").isin(wanted) if wanted else F.lit(False)
    tops: dict[tuple[int, int], list] = {}
    for r in d.top_values.where(chosen).orderBy("pattern_id", "slot", "rank").collect():
        tops.setdefault((r.pattern_id, r.slot), []).append((r.value, r.n, r.pct))
    for r in d.slots.where(chosen).orderBy("pattern_id", "slot").collect():
        numeric = None if r.num_count is None or r.var_type not in ("Integer", "Float", "Duration") and not r.num_count else {k: r[k] for k in ("mean", "p50", "p99", "min", "max")}
        made[r.pattern_id].slots.append(Slot(r.var_type, r.label, r.unique_count, numeric, tops.get((r.pattern_id, r.slot), [])))
    if options.context > 0:
        for r in d.examples.where(chosen).orderBy("pattern_id", "line_number").collect():
            made[r.pattern_id].examples.append(r.raw)
    by_count, critical, high = [[made[r.pattern_id] for r in rows] for rows in lists]
    return Report(s.total_lines, s.pattern_count, day(s[2]), day(s[3]), by_count, critical, high)

