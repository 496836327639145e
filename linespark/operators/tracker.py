"""Rule-driven state tracking and state lookup."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import BLOCK_LINES, scan


@dataclass(frozen=True)
class Rule:
    """``when`` selects lines; ``set`` gives new values (literals or columns); ``clear`` resets to defaults."""

    name: str
    when: Column
    set: dict = field(default_factory=dict)
    clear: tuple = ()


def _text(value) -> Column:
    if isinstance(value, Column):
        return value.cast("string")
    if isinstance(value, bool):
        return F.lit("true" if value else "false")
    return F.lit(None if value is None else str(value)).cast("string")


def captures(column: str, pattern: str, *groups: int) -> tuple[Column, ...]:
    """Capture groups of a pattern that is known to match; a group that took no part gives ``""``."""
    return tuple(F.regexp_extract(F.col(column), pattern, g) for g in groups)


def track_state(lines: DataFrame, rules: list[Rule], defaults: dict, tracker: str = "tracker",
                block_lines: int = BLOCK_LINES, keep_state: bool = False) -> DataFrame:
    """Transitions of a state machine whose first matching rule wins, even if it changes nothing.

    Only matched lines are shuffled. Per field the line's rule yields either a wrapped new
    value or NULL; the state before a line is the latest wrapped value before it, so the
    whole machine is one block scan. ``keep_state`` adds the full state after each
    transition as ``state``.
    """
    fields = list(defaults)
    for r in rules:
        unknown = (set(r.set) | set(r.clear)) - set(fields)
        if unknown:
            raise ValueError(f"rule {r.name!r} names undeclared fields: {sorted(unknown)}")
    if not rules:
        raise ValueError("a tracker needs at least one rule")
    pick = None
    for i, r in enumerate(rules):
        cond = F.coalesce(r.when, F.lit(False))
        pick = F.when(cond, F.lit(i)) if pick is None else pick.when(cond, F.lit(i))
    # Generated, so that the rules are tested once per line and not again for the filter.
    hit = lines.select("*", F.inline(F.array(F.struct(pick.alias("_rule"))))).filter(F.col("_rule").isNotNull())

    def delta(f: str) -> Column:
        out = None
        for i, r in enumerate(rules):
            if f in r.clear:
                v = _text(defaults[f])
            elif f in r.set:
                v = _text(r.set[f])
            else:
                continue
            wrapped = F.struct(v.alias("v"))
            cond = F.col("_rule") == i
            out = F.when(cond, wrapped) if out is None else out.when(cond, wrapped)
        return F.lit(None).cast("struct<v:string>") if out is None else out

    touched = [f for f in fields if any(f in r.set or f in r.clear for r in rules)]
    names = F.array(*[F.lit(r.name) for r in rules])
    base = hit.select("source_id", "line_num", "ts_ns", F.element_at(names, F.col("_rule") + 1).alias("transition"),
                      *[delta(f).alias(f"_d_{f}") for f in touched])
    seen = scan(base, prev={f"_was_{f}": F.col(f"_d_{f}") for f in touched}, block_lines=block_lines)

    def before(f: str) -> Column:
        return F.when(F.col(f"_was_{f}").isNotNull(), F.col(f"_was_{f}.v")).otherwise(_text(defaults[f]))

    def now(f: str) -> Column:
        return F.when(F.col(f"_d_{f}").isNotNull(), F.col(f"_d_{f}.v")).otherwise(before(f))

    entries = F.array(*[
        F.when(~now(f).eqNullSafe(before(f)),
               F.struct(F.lit(f).alias("key"), F.struct(before(f).alias("from"), now(f).alias("to")).alias("value")))
        for f in touched])
    entries = F.filter(entries, lambda e: e.isNotNull())
    out = seen.withColumn("_changes", entries).filter(F.size("_changes") > 0)
    cols = [F.col("source_id"), F.lit(tracker).alias("tracker"), F.col("line_num"), F.col("ts_ns"),
            F.col("transition"), F.map_from_entries("_changes").alias("changes")]
    if keep_state:
        state = []
        for f in fields:
            state += [F.lit(f), now(f) if f in touched else _text(defaults[f])]
        cols.append(F.create_map(*state).alias("state"))
    return out.select(*cols)


def flat_changes(transitions: DataFrame) -> DataFrame:
    """One row per changed field: ``field``, ``from_value``, ``to_value``."""
    return transitions.select(*[c for c in transitions.columns if c != "changes"],
                              F.explode("changes").alias("field", "_c")).select(
        "*", F.col("_c.from").alias("from_value"), F.col("_c.to").alias("to_value")).drop("_c")


def state_at(transitions: DataFrame, points: DataFrame, defaults: dict, mode: str = "time_series",
             block_lines: int = BLOCK_LINES) -> DataFrame:
    """State as of each point ``(source_id, line_num)``, defaults before the first transition.

    Adds one column per field, ``initialized_fields``, and the deciding transition's line and
    time. ``mode="snapshot"`` gives the final state whatever the point.
    """
    if mode not in ("time_series", "snapshot"):
        raise ValueError("mode must be 'time_series' or 'snapshot'")
    fields = list(defaults)
    val = lambda f: F.when(F.map_contains_key("changes", F.lit(f)),
                           F.struct(F.try_element_at("changes", F.lit(f)).getField("to").alias("v")))
    marks = transitions.select("source_id", "line_num", "ts_ns", *[val(f).alias(f"_v_{f}") for f in fields])
    at = F.struct(F.col("line_num").alias("line"), F.col("ts_ns").alias("ts"))
    if mode == "snapshot":
        final = marks.groupBy("source_id").agg(
            *[F.max_by(f"_v_{f}", F.when(F.col(f"_v_{f}").isNotNull(), F.col("line_num"))).alias(f"_s_{f}") for f in fields],
            F.max_by(at, F.col("line_num")).alias("_at"))
        found = points.join(final, "source_id", "left")
    else:
        point_cols = [c for c in points.columns if c not in ("source_id", "line_num")]
        payload = F.struct(*point_cols) if point_cols else F.lit(None).cast("int")
        both = marks.withColumn("_point", F.lit(0)).unionByName(
            points.select("source_id", "line_num", payload.alias("_payload"), F.lit(1).alias("_point")),
            allowMissingColumns=True)
        got = scan(both, order=("line_num", "_point"), block_lines=block_lines,
                   prev={**{f"_s_{f}": F.col(f"_v_{f}") for f in fields},
                         "_at": F.when(F.col("_point") == 0, at)})
        found = got.filter(F.col("_point") == 1)
        found = found.select("source_id", "line_num", *([F.col("_payload.*")] if point_cols else []),
                             *[f"_s_{f}" for f in fields], "_at")
    known = F.filter(F.array(*[F.when(F.col(f"_s_{f}").isNotNull(), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return found.withColumns({
        **{f: F.when(F.col(f"_s_{f}").isNotNull(), F.col(f"_s_{f}.v")).otherwise(_text(defaults[f])) for f in fields},
        "initialized_fields": known,
        "state_line": F.coalesce("_at.line", F.lit(0)),
        "state_ts_ns": F.col("_at.ts"),
    }).drop("_at", *[f"_s_{f}" for f in fields])


def final_state(transitions: DataFrame, defaults: dict) -> DataFrame:
    """Last state per source that has transitions; defaults fill untouched fields."""
    points = transitions.select("source_id").distinct().withColumn("line_num", F.lit(0).cast("bigint"))
    return state_at(transitions, points, defaults, mode="snapshot").drop("line_num")


def transition_lines(transitions: DataFrame) -> DataFrame:
    """Distinct lines at which a tracker changed."""
    return transitions.select("source_id", "tracker", "line_num").distinct()


def recent_transitions(transitions: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` newest transitions, newest first."""
    return transitions.orderBy(F.desc("line_num"), "source_id", "tracker").limit(n)


def state_intervals(transitions: DataFrame, field: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Spans during which a field kept one value; the last span is open (NULL end)."""
    own = transitions.filter(F.map_contains_key("changes", F.lit(field))).select(
        "source_id", "tracker", "line_num", "ts_ns", F.element_at("changes", F.lit(field)).getField("to").alias("value"))
    out = scan(own, keys=("source_id", "tracker"), block_lines=block_lines,
               next={"_next": F.struct("line_num", "ts_ns")})
    return out.select("source_id", "tracker", F.lit(field).alias("field"), "value",
                      F.col("line_num").alias("start_line"), F.col("ts_ns").alias("start_ts_ns"),
                      F.col("_next.line_num").alias("end_line"), F.col("_next.ts_ns").alias("end_ts_ns"),
                      (F.col("_next.ts_ns") - F.col("ts_ns")).alias("duration_ns"))


def mask_transitions(transitions: DataFrame, pii_map: DataFrame, salts: int = 16) -> DataFrame:
    """Replace from/to values that equal a known raw PII value by its token; NULL and unknown values stay.

    Both sides of a change go through one join. States such as "true" or an empty text may be most of all
    values, so each value is dealt over ``salts`` join keys and the map is repeated as often; NULLs, which no entry
    can match, are dealt by line.
    """
    ident = ["source_id", "tracker", "line_num", "ts_ns", "transition"]
    change = transitions.select(*ident, F.explode("changes").alias("_f", "_c"))
    sides = change.select(*ident, "_f", F.inline(F.array(F.struct(F.lit(True).alias("_old"), F.col("_c.from").alias("_v")),
                                                         F.struct(F.lit(False).alias("_old"), F.col("_c.to").alias("_v")))))
    place = F.xxhash64("source_id", "line_num", "_f")
    dealt = sides.withColumns({"_salt": F.pmod(place, F.lit(salts)).cast("int"), "_key": F.coalesce("_v", place.cast("string"))})
    tokens = pii_map.select(F.col("raw").alias("_key"), F.col("token").alias("_token"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    value = F.when(F.col("_v").isNotNull(), F.coalesce("_token", "_v"))
    whole = dealt.join(tokens, ["_key", "_salt"], "left").groupBy(*ident).agg(
        F.collect_list(F.struct("_old", F.col("_f").alias("key"), value.alias("value"))).alias("_sides"))
    side = lambda old: F.map_from_entries(F.transform(F.filter("_sides", lambda x: x["_old"] == F.lit(old)), lambda x: F.struct(x["key"], x["value"])))
    pair = F.map_zip_with(side(True), side(False), lambda _, old, new: F.struct(old.alias("from"), new.alias("to")))
    return whole.select(*ident, pair.alias("changes"))
