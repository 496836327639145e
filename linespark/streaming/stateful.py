"""Operators whose state lives across micro-batches.

Each is the streaming form of a batch operator and gives the same rows. Predicates, captures and values are evaluated
natively first, so that only matched lines reach the stateful step. State is typed (``transformWithStateInPandas``): a
burst keeps ``threshold`` times per key, a tracker one entry per field, a correlation what a later trigger can still match.

Order. Without ``delay`` the rows of one micro-batch are sorted by line and a row of a later batch is applied when it
comes. With ``delay`` (an interval such as ``"10 minutes"``) rows wait in a list until the watermark (latest matched time less
``delay``) has passed them and every earlier line that waits, and are then applied in line order: rows that come in a later
batch, at most ``delay`` behind, give the batch result. Rows later than that are left out, as in any watermarked
aggregate; lines without a time wait for the earlier lines only. What the watermark has not passed stays in state, so a
stream that ends has given the lines before each source's first line at or after its last watermark.

These operators need the RocksDB state store; it is set for the session, unless another than the default is already.
"""

from __future__ import annotations

import json
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.scalars import NS_PER_MS, as_col, render_template
from ..operators.correlate import Source, _records
from ..operators.stateful import DEFAULT_KEY
from ..operators.tracker import Rule, _text

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _use_rocksdb(spark: SparkSession) -> None:
    if "HDFSBackedStateStoreProvider" in spark.conf.get(PROVIDER, "HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)


#: Rows in one entry of the waiting list, and entries in one message to the store.
RUN = 1 << 10


class InOrder(StatefulProcessor):
    """Hands the rows of a key to ``apply`` in line order: at once, or when the watermark has passed them.

    A row is a tuple of ``fields``, which begin with line_num and a time in ns (0: none); ``ties`` of them make the order.
    """

    fields: dict[str, str] = {}
    output: list[str] = []
    ties = 1

    def __init__(self, delayed: bool):
        self.delayed = delayed

    def init(self, handle) -> None:
        self.handle = handle
        if self.delayed:
            # An entry is a run of rows, column by column: each entry crosses to the store by itself, whatever it holds.
            self.waiting = handle.getListState("waiting", ", ".join(f"{n} array<{t}>" for n, t in self.fields.items()))
        self.open(handle)

    def open(self, handle) -> None:
        """Declare the operator's own state."""
        raise NotImplementedError

    def apply(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        """Take rows in line order into the state; the rows to give out."""
        raise NotImplementedError

    def settle(self, watermark_ns: int) -> None:
        """Forget what no row after the watermark can need."""

    def place(self, row: tuple) -> tuple:
        return row[0], *row[2:1 + self.ties]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in pdf[list(self.fields)].itertuples(index=False, name=None)]
        if not self.delayed:
            yield from self.given(self.apply(key, sorted(new, key=self.place)))
            return
        yield from self.given(self.release(key, timerValues, new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.given(self.release(key, timerValues, []))

    def release(self, key, timers, new: list[tuple]) -> list[tuple]:
        """Apply the waiting and new rows before the first one at or after the watermark; a timer wakes the key for that one."""
        rows = sorted([*(r for run in self.waiting.get() for r in zip(*run)), *new], key=self.place)
        watermark = timers.getCurrentWatermarkInMs() * NS_PER_MS
        cut = next((i for i, r in enumerate(rows) if r[1] >= watermark), len(rows))
        out = self.apply(key, rows[:cut]) if cut else []
        self.settle(watermark)
        if cut:
            self.waiting.clear()
            self.wait(rows[cut:])
        else:
            self.wait(new)
        if cut < len(rows):
            self.handle.registerTimer(rows[cut][1] // NS_PER_MS + 1)
        return out

    def wait(self, rows: list[tuple]) -> None:
        runs = [tuple(map(list, zip(*rows[i:i + RUN]))) for i in range(0, len(rows), RUN)]
        for i in range(0, len(runs), RUN):
            self.waiting.appendList(runs[i:i + RUN])

    def given(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame({n: pd.Series(v, dtype="Int64" if n.endswith("_ns") else None)
                                for n, v in zip(self.output, zip(*rows))})

    def close(self) -> None:
        pass


def _run(rows: DataFrame, keys: list[str], processor: InOrder, schema: str, delay: str | None, idle: bool = False) -> DataFrame:
    _use_rocksdb(rows.sparkSession)
    mode = "ProcessingTime" if idle else "None"
    if delay:
        # A missing time stays missing for the watermark, so it neither moves it nor makes the line late.
        mode, rows = "EventTime", rows.withColumn("_ts", F.timestamp_micros(F.expr("nullif(ts_ns, 0) div 1000"))).withWatermark("_ts", delay)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", mode)


class BurstState(InOrder):
    fields = {"line_num": "long", "ts_ns": "long"}
    output = ["source_id", "burst_key", "count_in_window", "window_ms", "line_num", "ts_ns"]

    def __init__(self, window_ms: int, threshold: int, idle_ms: int | None, delayed: bool):
        super().__init__(delayed)
        self.window_ms, self.threshold, self.idle_ms = window_ms, threshold, idle_ms

    def open(self, handle) -> None:
        self.state = handle.getValueState("burst", "recent array<long>, hot boolean", self.idle_ms)

    def apply(self, key, rows):
        held = self.state.get()
        recent, hot = (list(held[0]), held[1]) if held else ([], False)
        out = []
        for line, ts in rows:
            # Running maxima, as in the batch form, so times may go backwards.
            recent = (recent + [max([ts, *recent[-1:]])])[-self.threshold:]
            now = len(recent) == self.threshold and recent[-1] - recent[0] <= self.window_ms * NS_PER_MS
            if now and not hot:
                out.append((key[0], key[1], self.threshold, self.window_ms, line, ts))
            hot = now
        self.state.update(([int(t) for t in recent], bool(hot)))
        return out


def stream_burst(df: DataFrame, key: Column | str, window_ms: int = 2000, threshold: int = 20,
                 idle_timeout_ms: int | None = None, delay: str | None = None) -> DataFrame:
    """Rising edges of the per-key count; ``line_num`` is the line completing the burst.

    ``idle_timeout_ms`` forgets a key after that processing time without lines (a time to live of its state); it goes by
    another clock than ``delay`` and cannot be given with it.
    """
    if idle_timeout_ms and delay:
        raise ValueError("idle_timeout_ms counts processing time, delay event time: give one of them")
    keyed = df.select("source_id", F.coalesce(as_col(key).cast("string"), F.lit(DEFAULT_KEY)).alias("burst_key"),
                      "line_num", F.coalesce("ts_ns", F.lit(0)).alias("ts_ns"))
    return _run(keyed, ["source_id", "burst_key"], BurstState(window_ms, threshold, idle_timeout_ms, bool(delay)),
                "source_id string, burst_key string, count_in_window long, window_ms long, line_num long, ts_ns long",
                delay, bool(idle_timeout_ms))


class TrackState(InOrder):
    fields = {"line_num": "long", "ts_ns": "long", "timed": "boolean", "rule": "int", "sets": "string"}
    output = ["source_id", "line_num", "ts_ns", "transition", "_changes"]

    def __init__(self, names: list[str], defaults: dict[str, str | None], delayed: bool):
        super().__init__(delayed)
        self.names, self.defaults = names, defaults

    def open(self, handle) -> None:
        self.state = handle.getMapState("fields", "field string", "value string")

    def apply(self, key, rows):
        was = {**self.defaults, **{f[0]: v[0] for f, v in self.state.iterator()}}
        cur, out = dict(was), []
        for line, ts, timed, rule, sets in rows:
            new = {**cur, **{e["f"]: e.get("v") for e in json.loads(sets)}}
            changed = {f: {"from": cur[f], "to": new[f]} for f in self.defaults if cur[f] != new[f]}
            if changed:
                out.append((key[0], line, ts if timed else None, self.names[rule], json.dumps(changed)))
            cur = new
        for f, v in cur.items():
            if v != was[f]:
                self.state.updateValue((f,), (v,))
        return out


def stream_track(df: DataFrame, rules: list[Rule], defaults: dict, tracker: str = "tracker", delay: str | None = None) -> DataFrame:
    """Transitions with state per source; ``changes`` as in the batch tracker."""
    pick = None
    for i, r in enumerate(rules):
        cond = F.coalesce(r.when, F.lit(False))
        pick = F.when(cond, F.lit(i)) if pick is None else pick.when(cond, F.lit(i))

    def updates(r: Rule) -> Column:
        values = {**{f: _text(v) for f, v in r.set.items()}, **{f: _text(defaults[f]) for f in r.clear}}
        return F.array(*[F.struct(F.lit(f).alias("f"), v.alias("v")) for f, v in values.items()])

    per_rule = None
    for i, r in enumerate(rules):
        cond = F.col("rule") == i
        per_rule = F.when(cond, updates(r)) if per_rule is None else per_rule.when(cond, updates(r))
    hit = df.withColumn("rule", pick).filter("rule IS NOT NULL")
    base = hit.select("source_id", "line_num", F.coalesce("ts_ns", F.lit(0)).alias("ts_ns"), F.col("ts_ns").isNotNull().alias("timed"),
                      "rule", F.to_json(per_rule, {"ignoreNullFields": "false"}).alias("sets"))
    text = lambda v: None if v is None else ("true" if v is True else "false" if v is False else str(v))
    flat = _run(base, ["source_id"], TrackState([r.name for r in rules], {f: text(v) for f, v in defaults.items()}, bool(delay)),
                "source_id string, line_num long, ts_ns long, transition string, _changes string", delay)
    changes = F.from_json("_changes", "map<string,struct<from:string,to:string>>")
    return flat.select("source_id", F.lit(tracker).alias("tracker"), "line_num", "ts_ns", "transition", changes.alias("changes"))


class CorrelateState(InOrder):
    """Cause records since the last firing that a later trigger can still match.

    Without any window each cause is one entry, its count and latest record. With one the records are a list: those out of
    the line window go after each batch, and with ``delay`` those whose time window the watermark has passed.
    """

    fields = {"line_num": "long", "ts_ns": "long", "ord": "int", "cause": "string", "fields": "string"}
    output = ["source_id", "trigger_line", "trigger_ts_ns", "matches", "_slots", "_counts"]
    ties = 2

    def __init__(self, trigger_ord: int, trigger_id: str, ids: list[str], lines: int | None, width: int | None, delayed: bool):
        super().__init__(delayed)
        self.trigger_ord, self.trigger_id, self.ids, self.lines, self.width = trigger_ord, trigger_id, ids, lines, width
        self.windowed = lines is not None or width is not None

    def open(self, handle) -> None:
        if self.windowed:
            self.held = handle.getListState("held", "cause string, line long, ts long, fields string")
        else:
            self.latest = handle.getMapState("latest", "cause string", "n long, fields string")

    def fired(self, key, line: int, ts: int, fields: str, latest: dict[str, tuple[int, str]]) -> tuple:
        slots = {f"{self.trigger_id}.{n}": v for n, v in json.loads(fields).items()}
        slots.update({f"{c}.{n}": v for c, (_, f) in latest.items() for n, v in json.loads(f).items()})
        return (key[0], line, ts, sum(n for n, _ in latest.values()), json.dumps(slots), json.dumps({c: n for c, (n, _) in latest.items()}))

    def apply(self, key, rows):
        if not rows:
            return []
        return self.apply_windowed(key, rows) if self.windowed else self.apply_unbounded(key, rows)

    def apply_unbounded(self, key, rows):
        latest = {c[0]: (v[0], v[1]) for c, v in self.latest.iterator()}
        known, out = set(latest), []
        for line, ts, order, cause, fields in rows:
            if order != self.trigger_ord:
                latest[cause] = (latest.get(cause, (0, ""))[0] + 1, fields)
            elif self.ids and all(c in latest for c in self.ids):
                out.append(self.fired(key, line, ts, fields, {c: latest[c] for c in self.ids}))
                latest = {}
        for c in known - set(latest):
            self.latest.removeKey((c,))
        for c, v in latest.items():
            self.latest.updateValue((c,), v)
        return out

    def apply_windowed(self, key, rows):
        if all(r[2] != self.trigger_ord for r in rows) and self.lines is None:
            self.held.appendList([(c, line, ts, f) for line, ts, _, c, f in rows])
            return []
        held, out = [tuple(r) for r in self.held.get()], []
        for line, ts, order, cause, fields in rows:
            if order != self.trigger_ord:
                held.append((cause, line, ts, fields))
                continue
            held = [r for r in held if (self.lines is None or line - r[1] <= self.lines) and (self.width is None or ts - r[2] <= self.width)]
            by_cause = {c: [r for r in held if r[0] == c] for c in self.ids}
            if self.ids and all(by_cause.values()):
                out.append(self.fired(key, line, ts, fields, {c: (len(rs), rs[-1][3]) for c, rs in by_cause.items()}))
                held = []
        if self.lines is not None:
            # Later triggers have larger line numbers, so these can never match again.
            held = [r for r in held if rows[-1][0] - r[1] <= self.lines]
        self.keep(held)
        return out

    def keep(self, held: list[tuple]) -> None:
        if held:
            self.held.put(held)
        else:
            self.held.clear()

    def settle(self, watermark_ns: int) -> None:
        if self.width is not None:
            held = [tuple(r) for r in self.held.get()]
            # Waiting and coming triggers are at or after the watermark.
            alive = [r for r in held if watermark_ns - r[2] <= self.width]
            if len(alive) < len(held):
                self.keep(alive)


def stream_correlate(df: DataFrame, trigger: Source, sources: list[Source], within_lines: int | None = None,
                     within_ms: int | None = None, emit: str = "", trigger_first: bool = True, delay: str | None = None) -> DataFrame:
    """One row per fired trigger: matches, and the latest record of each cause as JSON fields in the message.

    With ``delay`` and ``within_ms`` a trigger without a time matches only causes that the time window has not let go yet.
    """
    declared = [trigger, *sources] if trigger_first else [*sources, trigger]
    recs = _records(df, declared).select("source_id", "line_num", "ts_ns", F.col("_ord").cast("int").alias("ord"), "cause",
                                         F.to_json("fields").alias("fields"))
    processor = CorrelateState(declared.index(trigger), trigger.id, [s.id for s in sources], within_lines,
                               None if within_ms is None else within_ms * NS_PER_MS, bool(delay))
    flat = _run(recs, ["source_id"], processor,
                "source_id string, trigger_line long, trigger_ts_ns long, matches long, _slots string, _counts string", delay)
    slots = F.from_json("_slots", "map<string,string>")
    names = [f"{s.id}.{n}" for s in (trigger, *sources) for n in s.fields]
    message = render_template(emit, {n: F.try_element_at("_m", F.lit(n)) for n in names}, missing=None)
    return flat.withColumn("_m", slots).select(
        "source_id", "trigger_line", "trigger_ts_ns", "matches",
        F.from_json("_counts", "map<string,long>").alias("counts"), message.alias("message"))
