"""What a packaged analysis is: which lines it takes and what it makes of them."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.charts import Chart, build_charts
from ..operators.insights import Signal, insights, told
from ..operators.sections import in_sections, with_section
from ..operators.tracker import Rule, final_state, track_state


@dataclass(frozen=True)
class Job:
    """A reporter: ``analyse`` turns the kept lines into named tables.

    ``emissions`` are typed rows per line and ``summary`` one row per source; counters by value are
    long tables under their own names. Signals per row are raised from the table ``raised_from``. Running
    a job only declares its tables: charts, whose ranks need a pass of their own, are drawn on demand.
    """

    id: str
    where: Callable[[], Column]
    analyse: Callable[[DataFrame], dict[str, DataFrame]]
    sections: tuple[str, ...] = ()
    source_types: tuple[str, ...] = ("logcat", "bugreport")
    charts: tuple[Chart, ...] = ()
    signals: Callable[[], list[Signal]] = list
    raised_from: str = "emissions"

    def select(self, lines: DataFrame, sections: DataFrame | None = None) -> DataFrame:
        """The job's own lines: rules first, then the section gate on what is left."""
        kept = lines.filter(self.where())
        if self.sections and sections is not None:
            kept = in_sections(kept, sections, list(self.sections))
        return kept

    def run(self, lines: DataFrame, sections: DataFrame | None = None) -> dict[str, DataFrame]:
        return self.analyse(self.select(lines, sections))

    def draw(self, result: dict[str, DataFrame]) -> DataFrame:
        """The job's charts as one table."""
        if not self.charts:
            raise ValueError(f"{self.id} has no charts")
        return build_charts(result["emissions"], list(self.charts))

    def insights(self, result: dict[str, DataFrame], max_signals: int = 20) -> DataFrame:
        return insights(result[self.raised_from], result.get("summary"), self.signals(), self.id, max_signals)

    def summary_text(self, result: dict[str, DataFrame]) -> DataFrame:
        """One line of text per source: the summary's columns with their values, missing ones left out."""
        s = result["summary"]
        return s.select("source_id", told([c for c in s.columns if c != "source_id"]).alias("summary"))


@dataclass(frozen=True)
class Tracker:
    """A state tracker: ordered rules over its lines, defaults, and how its state is read."""

    id: str
    rules: Callable[[], list[Rule]]
    defaults: dict = field(default_factory=dict)
    sections: tuple[str, ...] = ()
    needs_section: bool = False
    source_types: tuple[str, ...] = ("logcat", "bugreport")
    mode: str = "time_series"

    def run(self, lines: DataFrame, sections: DataFrame | None = None) -> DataFrame:
        rules = self.rules()
        if self.needs_section and "section" not in lines.columns:
            lines = (lines.withColumn("section", F.lit(None).cast("string")) if sections is None
                     else with_section(lines, sections))
        if self.sections and sections is not None:
            lines = in_sections(lines, sections, list(self.sections))
        return track_state(lines, rules, self.defaults, self.id)

    def final(self, transitions: DataFrame) -> DataFrame:
        return final_state(transitions, self.defaults)


def orelse(c: Column | str, default) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(default))


def has(text: str) -> Column:
    return F.col("message").contains(text)
