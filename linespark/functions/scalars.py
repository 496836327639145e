"""Small Column helpers: intervals, coercion, time text, display, templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

NS_PER_MS = 1_000_000
NS_PER_SEC = 1_000_000_000
NS_PER_DAY = 86_400 * NS_PER_SEC

# Accepted interval units in nanoseconds.
INTERVAL_UNITS = {
    "ns": 1, "us": 1_000, "µs": 1_000, "ms": NS_PER_MS,
    "s": NS_PER_SEC, "sec": NS_PER_SEC,
    "m": 60 * NS_PER_SEC, "min": 60 * NS_PER_SEC,
    "h": 3600 * NS_PER_SEC, "hr": 3600 * NS_PER_SEC, "hour": 3600 * NS_PER_SEC,
    "d": NS_PER_DAY, "day": NS_PER_DAY,
}


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def interval_ns(text: str | int) -> int:
    """``"5m"`` -> nanoseconds. A missing number means one; unknown units raise."""
    if isinstance(text, int):
        return text
    m = re.fullmatch(r"\s*(\d*)\s*([A-Za-zµ]+)\s*", text)
    if not m or m.group(2).lower() not in INTERVAL_UNITS:
        raise ValueError(f"unknown interval: {text!r}")
    return int(m.group(1) or 1) * INTERVAL_UNITS[m.group(2).lower()]


def bucket_floor(ts: Column | str, width: str | int) -> Column:
    """Start of the fixed-width bucket holding ``ts`` (truncates toward zero)."""
    w = interval_ns(width)
    if w <= 0:
        return F.lit(0).cast("bigint")
    t = as_col(ts).cast("bigint")
    return t - t % F.lit(w)


def int_div(a: Column, b: Column | int) -> Column:
    """Integer division that yields NULL on a zero divisor."""
    b = F.lit(b) if not isinstance(b, Column) else b
    a, b = a.cast("bigint"), b.cast("bigint")
    return F.when(b != 0, F.call_function("div", a, b))


def percent(part: Column, whole: Column) -> Column:
    """Whole-number percentage; NULL on a zero base."""
    return int_div(part * 100, whole)


def classify(col: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """First label whose lower bound is reached, bounds given highest first."""
    out = None
    for bound, label in steps:
        cond = col >= F.lit(bound)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(otherwise)) if out is not None else F.lit(otherwise)


def num(col: Column | str) -> Column:
    """Text to double; junk becomes 0, a missing value stays missing."""
    c = as_col(col)
    return F.when(c.isNotNull(), F.coalesce(c.try_cast("double"), F.lit(0.0)))


def host_of(url: Column | str) -> Column:
    """Host part of a URL, without port or credentials; NULL when there is none."""
    host = F.regexp_extract(as_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@\s]*@)?([^/:?#\s]+)", 1)
    return F.when(host != "", host)


def after_last_slash(col: Column | str) -> Column:
    """Text after the last ``/``; NULL when there is no slash."""
    c = as_col(col)
    return F.when(c.contains("/"), F.substring_index(c, "/", -1))


def time_of_day_ns(text: str, default: int | None = 0) -> int | None:
    """``HH:MM[:SS[.mmm]]`` -> ns of day, for plan-time arguments."""
    m = re.fullmatch(r"(\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.(\d{1,9}))?|(\d{1,2}):(\d{1,2})", text.strip())
    if not m:
        return default
    if m.group(1) is None:
        return (int(m.group(5)) * 3600 + int(m.group(6)) * 60) * NS_PER_SEC
    frac = int((m.group(4) or "0").ljust(9, "0"))
    return (int(m.group(1)) * 3600 + int(m.group(2)) * 60 + int(m.group(3))) * NS_PER_SEC + frac


def time_of_day_col(col: Column | str) -> Column:
    """Column form of :func:`time_of_day_ns`; NULL on bad text."""
    c = as_col(col)
    pat = r"^\s*(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,9}))?)?\s*$"
    part = lambda i: F.coalesce(F.regexp_extract(c, pat, i).try_cast("bigint"), F.lit(0))
    frac = F.rpad(F.regexp_extract(c, pat, 4), 9, "0").try_cast("bigint")
    total = (part(1) * 3600 + part(2) * 60 + part(3)) * NS_PER_SEC + F.coalesce(frac, F.lit(0))
    return F.when(c.rlike(pat), total)


def civil_ns(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column,
             frac_ns: Column | None = None) -> Column:
    """Unix ns of a UTC wall-clock time, independent of the session time zone.

    Impossible dates give NULL.
    """
    i = lambda c: c.cast("int")
    ok = month.between(1, 12) & day.between(1, 31)
    text = F.format_string("%04d-%02d-%02d", i(year), i(month), i(day))
    days = F.unix_date(F.when(ok, text).try_cast("date")).cast("bigint")
    secs = (days * 24 + hour.cast("bigint")) * 3600 + minute.cast("bigint") * 60 + second.cast("bigint")
    out = secs * NS_PER_SEC
    return out + frac_ns.cast("bigint") if frac_ns is not None else out


def text_ts_ns(col: Column | str, capture_year: int) -> Column:
    """``MM-DD HH:MM:SS[.frac]`` or ISO text -> Unix ns; NULL on bad text."""
    c = F.trim(as_col(col))
    pat = (r"^(?:(\d{4})-)?(\d{1,2})-(\d{1,2})[ T](\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?Z?$")
    part = lambda i, d: F.coalesce(F.regexp_extract(c, pat, i).try_cast("bigint"), F.lit(d))
    frac = F.coalesce(F.rpad(F.regexp_extract(c, pat, 7), 9, "0").try_cast("bigint"), F.lit(0))
    return F.when(c.rlike(pat), civil_ns(part(1, capture_year), part(2, 1), part(3, 1), part(4, 0),
                                         part(5, 0), part(6, 0), frac))


def hms_ms(h: Column, m: Column, s: Column, ms: Column) -> Column:
    """Clock parts to milliseconds."""
    b = lambda c: c.cast("bigint")
    return ((b(h) * 60 + b(m)) * 60 + b(s)) * 1000 + b(ms)


def duration_text(length: Column | str, unit: str = "ns") -> Column:
    """Short display of a duration: ``850ms``, ``12.3s``, ``4m 05s``, ``2h 07m``.

    ``unit`` is ``ns``, ``us`` or ``ms``: more than 292 years in ns do not fit a bigint.
    """
    ms = int_div(as_col(length), NS_PER_MS // INTERVAL_UNITS[unit])
    sec = int_div(ms, 1000)
    return (F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
            .when(sec < 60, F.format_string("%.1fs", (ms / 1000.0).cast("double")))
            .when(sec < 3600, F.format_string("%dm %02ds", int_div(sec, 60), sec % 60))
            .otherwise(F.format_string("%dh %02dm", int_div(sec, 3600), int_div(sec, 60) % 60)))


def timestamp_text(ns: Column | str) -> Column:
    """``HH:MM:SS.mmm`` of a Unix-ns value (UTC)."""
    ms = int_div(as_col(ns) % F.lit(NS_PER_DAY), NS_PER_MS)
    return F.format_string("%02d:%02d:%02d.%03d", int_div(ms, 3_600_000), int_div(ms, 60_000) % 60,
                           int_div(ms, 1000) % 60, ms % 1000)


def truncate_text(col: Column | str, n: int) -> Column:
    """First ``n`` characters followed by ``...`` when the text is longer."""
    c = as_col(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def render_template(template: str, fields: dict[str, Column], missing: str | None = "<unknown>") -> Column:
    """``{{key}}`` placeholders replaced by columns; the text is split when the plan is built.

    A NULL or undeclared key prints ``missing``; with ``missing=None`` the placeholder stays as written.
    """
    parts = []
    for piece in re.split(r"(\{\{[^{}]+\}\})", template):
        if not piece:
            continue
        m = re.fullmatch(r"\{\{\s*([^{}]+?)\s*\}\}", piece)
        if m is None:
            parts.append(F.lit(piece))
            continue
        fallback = F.lit(piece if missing is None else missing)
        col = fields.get(m.group(1))
        parts.append(fallback if col is None else F.coalesce(col.cast("string"), fallback))
    return F.concat(*parts) if parts else F.lit("")
