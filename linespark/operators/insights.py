"""Severity signals raised from result rows and summaries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.predicates import condition
from ..functions.scalars import render_template

SEVERITIES = ("critical", "warning", "info")


@dataclass(frozen=True)
class Signal:
    """Raised per result row (``kind="emission"``) or once per source from the summary (``"aggregate"``).

    Without a ``message`` template the text is the signal's name and its fields with their values.
    """

    name: str
    severity: str
    when: Column
    kind: str = "emission"
    fields: tuple = ()
    message: str | None = None


def told(fields) -> Column:
    """``a=1, b=2`` for the columns that have a value."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{f}="), F.col(f).cast("string")) for f in fields])


def insights(emissions: DataFrame, summary: DataFrame | None, signals: list[Signal], processor: str = "job",
             max_signals: int = 20) -> DataFrame:
    """Signals of one job, most severe first, at most ``max_signals`` per source.

    ``signal_count`` counts each signal before the cut; ``truncated`` tells that rows were left out.
    """
    parts = []
    ends = emissions.groupBy("source_id").agg(F.min("line_num").alias("_first"), F.max("line_num").alias("_last"))
    for i, s in enumerate(signals):
        if s.severity not in SEVERITIES:
            raise ValueError(f"unknown severity: {s.severity}")
        base = emissions if s.kind == "emission" else summary.join(ends, "source_id", "left")
        hit = base.filter(condition(s.when))
        cols = {c: F.col(c) for c in base.columns}
        picked = [F.struct(F.lit(f).alias("k"), F.col(f).cast("string").alias("v")) for f in s.fields]
        fields = (F.map_from_entries(F.filter(F.array(*picked), lambda p: p.v.isNotNull())) if picked
                  else F.create_map().cast("map<string,string>"))
        msg = render_template(s.message, cols) if s.message else F.concat_ws(": ", F.lit(s.name), told(s.fields)) if s.fields else F.lit(s.name)
        line = F.col("line_num") if s.kind == "emission" else F.col("_first")
        last = F.lit(None).cast("bigint") if s.kind == "emission" else F.col("_last")
        parts.append(hit.select("source_id", F.lit(processor).alias("processor"), F.lit(s.name).alias("name"),
                                F.lit(s.severity).alias("severity"), F.lit(SEVERITIES.index(s.severity)).alias("_sev"),
                                F.lit(i).alias("_def"), line.alias("line"), last.alias("last_line"),
                                msg.alias("message"), fields.cast("map<string,string>").alias("fields")))
    rows = reduce(DataFrame.unionByName, parts)
    counts = rows.groupBy("source_id", "name").agg(F.count("*").alias("signal_count"))
    totals = counts.groupBy("source_id").agg(F.sum("signal_count").alias("_total"))
    # Cut inside line blocks first, so that a signal raised on every line is not ranked in one task.
    order = ["_sev", "_def", "line", "message"]
    rows = rows.withColumn("_block", F.expr("coalesce(line, 0L) div 262144L"))
    near = W.partitionBy("source_id", "_block").orderBy(*order)
    whole = W.partitionBy("source_id").orderBy(*order)
    top = (rows.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= max_signals)
           .withColumn("position", F.row_number().over(whole)).filter(F.col("position") <= max_signals))
    return (top.join(counts, ["source_id", "name"]).join(totals, "source_id")
            .withColumn("truncated", F.col("_total") > max_signals)
            .drop("_r", "_sev", "_def", "_total", "_block"))
