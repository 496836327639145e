"""Cause/effect correlation.

A trigger fires when every cause has a record since the last firing that lies inside the
window. Firing clears all records. With one cause the buffer is empty after any trigger, so each
cause record can only ever meet the next trigger of its source: one backward block scan
assigns it, no join and no per-group collection. With several causes the last firing matters;
see :func:`_fired_several`.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field
from functools import reduce
from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import NS_PER_MS, render_template
from .ordered import BLOCK_LINES, scan

#: Blocks composed into one in a round, and the rounds: a source of 10^6 blocks leaves 1,000 tables to chain.
FAN = 1 << 10
ROUNDS = 1
TABLE = "source_id string, _block long, _first long, _from long, _to long"


@dataclass(frozen=True)
class Source:
    """Lines passing ``when``. ``fields`` are columns over the line; ``condition`` gets them as a dict."""

    id: str
    when: Column
    fields: dict = field(default_factory=dict)
    condition: Callable[[dict], Column] | None = None


def _records(lines: DataFrame, sources: list[Source]) -> DataFrame:
    """One row per line and matching source, numbered in declaration order, in a single pass."""
    out = []
    for i, s in enumerate(sources):
        pairs = [F.struct(F.lit(n).alias("k"), s.fields[n].cast("string").alias("v")) for n in sorted(s.fields)]
        fields = (F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.v.isNotNull())) if pairs
                  else F.create_map())
        ok = s.when if s.condition is None else s.when & s.condition(s.fields)
        out.append(F.when(ok, F.struct(F.lit(i).alias("_ord"), F.lit(s.id).alias("cause"),
                                       fields.cast("map<string,string>").alias("fields"))))
    hits = F.filter(F.array(*out), lambda r: r.isNotNull())
    any_hit = reduce(lambda x, y: x | y, [F.coalesce(s.when, F.lit(False)) for s in sources])
    return lines.filter(any_hit).select("source_id", "line_num", F.coalesce("ts_ns", F.lit(0)).alias("ts_ns"), "raw",
                                        F.inline(hits))


def _in_window(within_lines: int | None, within_ms: int | None) -> Column:
    ok = F.lit(True)
    if within_lines is not None:
        ok = ok & (F.col("_t.line_num") - F.col("line_num") <= within_lines)
    if within_ms is not None:
        ok = ok & (F.col("_t.ts_ns") - F.col("ts_ns") <= within_ms * NS_PER_MS)
    return ok


def correlation_matches(lines: DataFrame, trigger: Source, sources: list[Source], within_lines: int | None = None,
                        within_ms: int | None = None, trigger_first: bool = True,
                        block_lines: int = BLOCK_LINES) -> DataFrame:
    """One row per fired trigger and matched cause record.

    ``trigger_first`` tells whether the trigger is declared before the causes: on a line that is
    both, the source declared first is handled first.  Several causes with ``within_ms``
    need times that do not go backwards inside a source.
    """
    if not sources:
        return _records(lines, [trigger]).limit(0).select(
            "source_id", F.col("line_num").alias("trigger_line"), F.col("ts_ns").alias("trigger_ts_ns"),
            F.col("fields").alias("trigger_fields"), F.col("raw").alias("trigger_raw"), "cause", "line_num", "ts_ns",
            "fields", "raw")
    declared = [trigger, *sources] if trigger_first else [*sources, trigger]
    t_ord = declared.index(trigger)
    recs = _records(lines, declared)
    as_trigger = F.when(F.col("_ord") == t_ord, F.struct("line_num", "ts_ns", "fields", "raw"))
    if len(sources) == 1:
        seen = scan(recs, order=("line_num", "_ord"), next={"_t": as_trigger}, block_lines=block_lines)
        hits = seen.filter((F.col("_ord") != t_ord) & F.col("_t").isNotNull() & _in_window(within_lines, within_ms))
    else:
        fired = _fired_several(recs, [i for i in range(len(declared)) if i != t_ord], t_ord, within_lines, within_ms,
                               block_lines)
        # A record belongs to the next fired trigger of its source, if it is still in its window.
        mark = F.when((F.col("_ord") == t_ord) & F.col("_fired"), F.struct("line_num", "ts_ns", "fields", "raw"))
        seen = scan(fired, order=("line_num", "_ord"), next={"_t": mark}, block_lines=block_lines)
        hits = seen.filter((F.col("_ord") != t_ord) & F.col("_t").isNotNull() & _in_window(within_lines, within_ms))
    return hits.select("source_id", F.col("_t.line_num").alias("trigger_line"), F.col("_t.ts_ns").alias("trigger_ts_ns"),
                       F.col("_t.fields").alias("trigger_fields"), F.col("_t.raw").alias("trigger_raw"),
                       "cause", "line_num", "ts_ns", "fields", "raw")


def _walk(at: list[int], oldest: list[int], last: int) -> tuple[list[int], int]:
    """Triggers at ``at`` that fire after a firing at ``last``, and the last firing then."""
    out = []
    for a, o in zip(at, oldest):
        if o > last:
            out.append(a)
            last = a
    return out, last


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block as a step function: a last firing from ``_from`` on, below the next ``_from``, leads to ``_to``."""
    pdf = pdf.sort_values("_at")
    a, m = pdf["_at"].tolist(), pdf["_m"].tolist()
    # Entry points: the last firing lies below all carried-in records, or at/after some of them.
    edges = [-1] + sorted({o for o in m if o < a[0]})
    return pd.DataFrame({"source_id": pdf["source_id"].iloc[0], "_block": pdf["_block"].iloc[0], "_first": a[0],
                         "_from": edges, "_to": [_walk(a, m, e)[1] for e in edges]})


def _steps(pdf: pd.DataFrame) -> list[tuple[int, list[int], list[int]]]:
    """The tables of a group of blocks, in order."""
    return [(b, g["_from"].tolist(), g["_to"].tolist())
            for b, g in pdf.sort_values(["_block", "_from"]).groupby("_block", sort=True)]


def _after(froms: list[int], tos: list[int], last: int) -> int:
    """The last firing after a block; where none of its triggers fires it is the one before."""
    return max(last, tos[bisect_right(froms, last) - 1])


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    """One table for a run of blocks.

    Only entry points before the run's first trigger can tell incoming firings apart. They are latest
    records of a cause at that trigger, so there is still at most one per cause.
    """
    steps, first = _steps(pdf), int(pdf["_first"].min())
    edges = sorted({-1} | {e for _, froms, _ in steps for e in froms if e < first})
    tos = [reduce(lambda last, s: _after(s[1], s[2], last), steps, e) for e in edges]
    return pd.DataFrame({"source_id": pdf["source_id"].iloc[0], "_block": pdf["_group"].iloc[0], "_first": first,
                         "_from": edges, "_to": tos})


def _chained(pdf: pd.DataFrame) -> pd.DataFrame:
    """The last firing before each block of a run, given the one before the run."""
    last, rows = int(pdf["_last"].iloc[0]), []
    for block, froms, tos in _steps(pdf):
        rows.append((pdf["source_id"].iloc[0], block, last))
        last = _after(froms, tos, last)
    return pd.DataFrame(rows, columns=["source_id", "_block", "_last"])


def _entered(tables: DataFrame, rounds: int, fan: int) -> DataFrame:
    """The last firing before each block: up a tree of composed tables, then down again.

    A round composes runs of ``fan`` blocks into one, so that a task holds at most ``fan`` tables; what is
    left after ``rounds`` is chained per source, one table for ``fan ** rounds`` blocks.
    """
    entry = "source_id string, _block long, _last long"
    if rounds == 0:
        return tables.withColumn("_last", F.lit(-1).cast("bigint")).groupBy("source_id").applyInPandas(_chained, entry)
    runs = tables.withColumn("_group", F.expr(f"_block div {int(fan)}L"))
    above = runs.groupBy("source_id", "_group").applyInPandas(_composed, TABLE)
    known = _entered(above, rounds - 1, fan).withColumnRenamed("_block", "_group")
    return runs.join(known, ["source_id", "_group"]).groupBy("source_id", "_group").applyInPandas(_chained, entry)


def _fired_several(recs: DataFrame, causes: list[int], t_ord: int, within_lines: int | None, within_ms: int | None,
                   block_lines: int) -> DataFrame:
    """Mark the triggers that fire when every cause must be present.

    Let ``m`` be the oldest of the causes' latest records before a trigger. If all of those lie in
    the window, the trigger fires exactly when ``m`` is later than the last firing, so the
    triggers of a source form a chain. Inside a block, the last firing before the block
    matters only by how it compares with the records carried into the block, and there is
    one of those per cause. Each block is therefore summed up as a table of at most
    ``len(causes) + 1`` entries. Tables compose (:func:`_entered`), and a second pass marks
    the triggers of every block knowing its last firing.
    """
    pos = F.struct("line_num", "_ord", "ts_ns")
    latest = {f"_c{i}": F.when(F.col("_ord") == i, pos) for i in causes}
    seen = scan(recs, order=("line_num", "_ord"), prev=latest, block_lines=block_lines)
    trig = seen.filter(F.col("_ord") == t_ord)
    ok = F.lit(True)
    for i in causes:
        ok = ok & F.col(f"_c{i}").isNotNull()
        if within_lines is not None:
            ok = ok & (F.col("line_num") - F.col(f"_c{i}.line_num") <= within_lines)
        if within_ms is not None:
            ok = ok & (F.col("ts_ns") - F.col(f"_c{i}.ts_ns") <= within_ms * NS_PER_MS)
    n = max(max(causes), t_ord) + 1
    at = lambda c: F.col(f"{c}.line_num") * n + F.col(f"{c}._ord") if c else F.col("line_num") * n + F.col("_ord")
    oldest = F.least(*[at(f"_c{i}") for i in causes])
    able = trig.filter(F.coalesce(ok, F.lit(False))).select(
        "source_id", F.expr(f"line_num div {int(block_lines)}L").alias("_block"), at("").alias("_at"), oldest.alias("_m"))

    tables = able.groupBy("source_id", "_block").applyInPandas(_summed, TABLE)
    entries = _entered(tables, ROUNDS, FAN)

    def marked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        hit, _ = _walk(pdf["_at"].tolist(), pdf["_m"].tolist(), int(pdf["_last"].iloc[0]))
        return pd.DataFrame({"source_id": pdf["source_id"].iloc[0], "line_num": [h // n for h in hit],
                             "_fired": True})

    fired = able.join(entries, ["source_id", "_block"]).groupBy("source_id", "_block").applyInPandas(
        marked, "source_id string, line_num long, _fired boolean")
    out = recs.join(fired, ["source_id", "line_num"], "left")
    return out.withColumn("_fired", F.coalesce("_fired", F.lit(False)))


def correlate(lines: DataFrame, trigger: Source, sources: list[Source], within_lines: int | None = None,
              within_ms: int | None = None, emit: str = "", trigger_first: bool = True,
              block_lines: int = BLOCK_LINES) -> DataFrame:
    """One row per fired trigger: the number of matches and the latest record per cause, and the message.

    The counts and latest records are partial aggregates, so a trigger closing a very long run of
    causes costs no memory; the runs themselves are in :func:`correlation_matches`. ``emit`` may name
    ``{{source.field}}``; a field that is missing keeps its placeholder.
    """
    hits = correlation_matches(lines, trigger, sources, within_lines, within_ms, trigger_first, block_lines)
    latest = lambda s: F.max_by(F.struct("line_num", "ts_ns", "fields", "raw"),
                                F.when(F.col("cause") == s.id, F.col("line_num")))
    events = hits.groupBy("source_id", "trigger_line").agg(
        F.first("trigger_ts_ns").alias("trigger_ts_ns"), F.first("trigger_fields").alias("trigger_fields"),
        F.first("trigger_raw").alias("trigger_raw"), F.count("*").alias("matches"),
        *[F.count_if(F.col("cause") == s.id).alias(f"n_{s.id}") for s in sources],
        *[latest(s).alias(f"latest_{s.id}") for s in sources])
    slots = {f"{trigger.id}.{n}": F.try_element_at("trigger_fields", F.lit(n)) for n in trigger.fields}
    for s in sources:
        slots.update({f"{s.id}.{n}": F.try_element_at(F.col(f"latest_{s.id}.fields"), F.lit(n)) for n in s.fields})
    return events.withColumn("message", render_template(emit, slots, missing=None))
