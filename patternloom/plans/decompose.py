"""The whole analysis: lines to patterns, variables, statistics, anomalies, scores and correlations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import infer_label
from ..operators import anomalies, correlations, drain, extract, scoring, stats
from ..operators.parse import compacted, expanded, parse_lines
from ..sources.staging import collecting, drop_paths, finished, stage


def _step(make):
    """A cached property; the tables that making it stages belong to the analysis."""

    @wraps(make)
    def run(self):
        with collecting(self._staged):
            return make(self)

    return cached_property(run)


@dataclass
class Decomposition:
    """Tables of one analysis, each made when asked for.

    ``lines``: line_number, raw, or a function that returns them (what it stages is deleted when the lines are parsed). What several tables are made from is staged in the
    shared folder when first asked for; :meth:`close` deletes it.
    """

    lines: DataFrame | Callable[[], DataFrame]
    mode: str = "replay"
    context: int = 0
    default_year: int | None = None
    approximate: bool = False
    seed: int = 0
    config: drain.DrainConfig = drain.DrainConfig()
    _staged: list[str] = field(default_factory=list, init=False, repr=False)

    @_step
    def parsed(self) -> DataFrame:
        lines = lambda: self.lines if isinstance(self.lines, DataFrame) else self.lines()
        return expanded(finished(lambda: compacted(parse_lines(lines(), self.default_year)), "parsed"))

    @_step
    def assigned(self) -> DataFrame:
        return expanded(finished(lambda: compacted(drain.assign_patterns(self.parsed, self.mode, self.config)), "assigned"))

    @_step
    def templates(self) -> DataFrame:
        return stage(extract.display_templates(drain.templates(self.assigned)))

    @_step
    def variables(self) -> DataFrame:
        return stage(extract.extract_variables(self.assigned, self.templates))

    @_step
    def slot_values(self) -> DataFrame:
        return stats.slot_values(self.variables)

    @_step
    def top_values(self) -> DataFrame:
        return stats.top_values(self.slot_values)

    @_step
    def slots(self) -> DataFrame:
        """Slot statistics with labels."""
        rows = stats.slot_stats(self.variables, self.approximate).join(self.templates.select("pattern_id", "template"), "pattern_id")
        return stage(rows.withColumn("label", infer_label(F.col("template"), F.col("slot"), F.col("var_type"))).drop("template"))

    @_step
    def buckets(self) -> DataFrame:
        return stage(stats.minute_buckets(self.assigned))

    @_step
    def dense(self) -> DataFrame:
        return stage(stats.dense_buckets(self.buckets, self.templates))

    @_step
    def counted(self) -> DataFrame:
        return stats.pattern_stats(self.assigned).join(self.templates.select("pattern_id", "template"), "pattern_id")

    @_step
    def anomalies(self) -> DataFrame:
        return anomalies.detect_anomalies(self.counted, self.slots, self.buckets)

    @_step
    def patterns(self) -> DataFrame:
        """pattern_id, template, count, spans, keyword_weight, severity, score."""
        return stage(scoring.score_patterns(self.counted, self.anomalies))

    @_step
    def correlations(self) -> DataFrame:
        return correlations.find_correlations(self.counted, self.slots, self.top_values, self.buckets)

    @_step
    def examples(self) -> DataFrame:
        return stats.sample_lines(self.assigned, self.context, self.seed)

    @_step
    def summary(self) -> DataFrame:
        return stats.summary(self.assigned)

    def close(self) -> None:
        """Delete all staged tables; no table of the analysis can be read any more."""
        drop_paths(self._staged)


def decompose(lines: DataFrame, **options) -> Decomposition:
    return Decomposition(lines, **options)
