"""Line predicates. Every function returns a boolean Column over LINE columns.

Three tag rules exist on purpose: prefix (rules), substring ignoring case
(ad-hoc filters) and exact (search and cross-source queries).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .levels import level_rank
from .scalars import NS_PER_DAY, NS_PER_SEC, as_col, time_of_day_ns


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def _all(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


# -- rule predicates -------------------------------------------------------------------------

def tag_prefix(*tags: str) -> Column:
    """Tag starts with any of the given texts, case-sensitive."""
    return _any([F.col("tag").startswith(t) for t in tags])


def tag_regex(pattern: str) -> Column:
    return F.col("tag").rlike(pattern)


def message_contains(text: str) -> Column:
    return F.col("message").contains(text)


def message_contains_any(*texts: str) -> Column:
    return _any([F.col("message").contains(t) for t in texts])


def message_regex(pattern: str) -> Column:
    return F.col("message").rlike(pattern)


def level_min(level: str) -> Column:
    """Level at or above; an unknown level name lets every line pass."""
    return F.col("level_ord") >= F.lit(level_rank(level, 0))


def time_of_day(start: str, end: str) -> Column:
    """Clock time within [start, end]; no wrap past midnight. Bad text means 00:00."""
    clock = F.pmod(F.coalesce(F.col("ts_ns"), F.lit(0)), F.lit(NS_PER_DAY))
    return clock.between(time_of_day_ns(start), time_of_day_ns(end))


def source_type_is(name: str) -> Column:
    """Source type equals ``name`` ignoring case; a dumpstate also counts as a bugreport."""
    st = F.lower(F.col("source_type"))
    if name.lower() == "bugreport":
        return st.isin("bugreport", "dumpstate")
    return st == F.lit(name.lower())


def section_is(name: str) -> Column:
    """Innermost section has this name (needs ``with_section`` first)."""
    return F.coalesce(F.col("section") == F.lit(name), F.lit(False))


def all_of(*conds: Column) -> Column:
    """AND of rules. Give cheap rules first: Spark keeps the order and stops at the first false."""
    return _all(list(conds))


# -- ad-hoc criteria -------------------------------------------------------------------------

def criteria(text: str | None = None, regex: str | None = None, levels: list[str] | None = None,
             tags: list[str] | None = None, time_start: int | None = None, time_end: int | None = None,
             pids: list[int] | None = None, combine: str = "and") -> Column:
    """Ad-hoc filter over raw text, level set, tag parts, time bounds and pids.

    Absent or empty criteria are ignored; with none at all every line passes. Each
    time bound is a criterion of its own; a line without a time fails both.
    """
    if combine not in ("and", "or"):
        raise ValueError("combine must be 'and' or 'or'")
    conds = []
    if levels:
        conds.append(F.col("level_ord").isin([level_rank(x, -1) for x in levels]))
    if pids:
        conds.append(F.col("pid").isin(list(pids)))
    if time_start is not None:
        conds.append(condition(F.col("ts_ns") >= time_start))
    if time_end is not None:
        conds.append(condition(F.col("ts_ns") <= time_end))
    if tags:
        low = F.lower(F.col("tag"))
        conds.append(_any([low.contains(t.lower()) for t in tags]))
    if text:
        conds.append(F.lower(F.col("raw")).contains(text.lower()))
    if regex:
        conds.append(F.col("raw").rlike(regex))
    return _all(conds) if combine == "and" or not conds else _any(conds)


# -- expression atoms, combined with & | ~ ----------------------------------------------------

def tag_has(text: str) -> Column:
    return F.lower(F.col("tag")).contains(text.lower())


def message_has(text: str) -> Column:
    return F.lower(F.col("message")).contains(text.lower())


def raw_has(text: str) -> Column:
    return F.lower(F.col("raw")).contains(text.lower())


def level_eq(level: str) -> Column:
    return F.col("level_ord") == F.lit(level_rank(level, -1))


def pid_eq(pid: int) -> Column:
    return F.col("pid") == F.lit(pid)


def tid_eq(tid: int) -> Column:
    return F.col("tid") == F.lit(tid)


def text_any(text: str) -> Column:
    """Text in raw, tag or message, ignoring case."""
    return raw_has(text) | tag_has(text) | message_has(text)


# -- ranges ----------------------------------------------------------------------------------

def line_range(start: int | None, end: int | None) -> Column:
    """Line number within [start, end)."""
    conds = []
    if start is not None:
        conds.append(F.col("line_num") >= start)
    if end is not None:
        conds.append(F.col("line_num") < end)
    return _all(conds)


def ts_between(start: int | None, end: int | None) -> Column:
    """Time within [start, end]."""
    conds = []
    if start is not None:
        conds.append(F.col("ts_ns") >= start)
    if end is not None:
        conds.append(F.col("ts_ns") <= end)
    return _all(conds)


def condition(expr: Column) -> Column:
    """A comparison in which a missing field means false, also for ``!=``."""
    return F.coalesce(expr, F.lit(False))


def search_condition(text: str | None = None, is_regex: bool = False, case_sensitive: bool = False,
                     min_level: str | None = None, tags: list[str] | None = None,
                     start_time: str | None = None, end_time: str | None = None,
                     column: str = "raw") -> Column:
    """Search rule on raw text with optional level, exact tags and clock bounds."""
    conds = []
    if min_level:
        conds.append(level_min(min_level))
    if tags:
        conds.append(F.col("tag").isin(list(tags)))
    clock = F.pmod(F.col("ts_ns"), F.lit(NS_PER_DAY))
    for bound, ge in ((start_time, True), (end_time, False)):
        ns = time_of_day_ns(bound, None) if bound else None
        if ns is not None and ns < NS_PER_DAY:
            ns -= ns % NS_PER_SEC
            conds.append(F.col("ts_ns").isNotNull() & ((clock >= ns) if ge else (clock <= ns)))
    if text:
        c = as_col(column)
        if is_regex:
            conds.append(c.rlike(text if case_sensitive else f"(?i){text}"))
        elif case_sensitive:
            conds.append(c.contains(text))
        else:
            conds.append(F.lower(c).contains(text.lower()))
    return _all(conds)
