"""URL filtering by a temporal list join.

List entries are dated: on a day a pattern is put on a list or taken off.  They become validity intervals, and every
capture is judged by the entries that were active on the day it was fetched.  A pattern is a host (with all hosts below it) or
``host/path`` (with everything below that path).  A capture looks its patterns up by equality (each suffix of its host, each
prefix of its path), so no pattern is ever tried against a capture that cannot match it.  The as-of condition is an equality too, on the month,
before days are compared: a pattern has at most 31 intervals that touch a month, however long its history or hot its host.
All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import safe_columns


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def normal_url(url: Column) -> Column:
    """``host/path`` in lower-case host, without scheme, user, port, query, fragment and closing slashes; null without a host."""
    rest = F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, "[?#].*$", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, "^([^/]*)", 1), "^.*@", ""), ":[0-9]*$", ""))
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/]*(/.*)$", 1), "/+$", "")
    return F.when(host != "", F.concat(host, path))


def patterns_of(place: Column) -> Column:
    """All patterns that cover a normal URL: its host's suffixes, then ``host/path`` prefixes."""
    host = F.split(F.element_at(F.split(place, "/"), 1), "\\.")
    segments = F.split(place, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(host)), lambda i: F.array_join(F.slice(host, i, F.size(host)), "."))
    prefixes = F.when(F.size(segments) > 1, F.transform(F.sequence(F.lit(2), F.size(segments)), lambda i: F.array_join(F.slice(segments, F.lit(1), i), "/")))
    return F.array_distinct(F.concat(suffixes, F.coalesce(prefixes, F.array().cast("array<string>"))))


def normal_pattern(pattern: Column) -> Column:
    """The host in lower case, as in :func:`normal_url`; the path as it is."""
    return F.concat(F.lower(F.regexp_extract(pattern, "^([^/]*)", 1)), F.regexp_extract(pattern, "(?s)^[^/]*(/.*)$", 1))


def validity(entries: DataFrame) -> DataFrame:
    """``list_id, pattern, valid_from, valid_to`` (exclusive, null: still valid) from ``list_id, pattern, day, action`` (add or remove).

    Repeated entries of a day are one, a removal wins over an addition of that day, an addition to what is listed changes nothing.
    Rows with a null or another action are left out. A pattern has one row a day at most, so its history is bounded by the calendar.
    """
    known = entries.filter(F.col("action").isin("add", "remove") & F.col("pattern").isNotNull() & F.col("day").isNotNull() & F.col("list_id").isNotNull())
    days = known.groupBy("list_id", normal_pattern(F.col("pattern")).alias("pattern"), F.col("day").cast("date").alias("day")).agg(F.max("action").alias("action"))
    w = W.partitionBy("list_id", "pattern").orderBy("day")
    changes = days.withColumn("_before", F.lag("action").over(w)).filter("action <> coalesce(_before, 'remove')")
    return changes.withColumn("valid_to", F.lead("day").over(w)).filter("action = 'add'").select("list_id", "pattern", F.col("day").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Add ``blocked``, ``n_entries`` (active entries that cover the capture) and ``pattern`` (the first of them by text) to ``capture_id, url, fetched``.

    A null or hostless URL or a null day is covered by nothing. Capture ids are distinct; rows that share one share their entries. Extra columns are
    carried along; raises if a result column is already there. Without entries nothing is blocked.
    """
    safe_columns(captures, ["blocked", "n_entries", "pattern"])
    day = F.col("fetched").cast("date")
    asked = captures.filter(day.isNotNull()).select("capture_id", day.alias("_day"), F.explode(patterns_of(normal_url(F.col("url")))).alias("pattern"))
    latest = captures.agg(F.max(day).alias("_latest"))  # one row
    valid = validity(entries).join(F.broadcast(latest), F.col("valid_from") <= F.col("_latest"))
    end = F.least(F.coalesce(F.date_sub("valid_to", 1), F.col("_latest")), F.col("_latest"))
    months = valid.select("list_id", "pattern", "valid_from", "valid_to", F.explode(F.sequence(_month(F.col("valid_from")), _month(end))).alias("_month"))
    met = asked.withColumn("_month", _month(F.col("_day"))).join(months, ["pattern", "_month"]).filter((F.col("_day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_day") < F.col("valid_to"))))
    found = met.groupBy("capture_id").agg(F.countDistinct("list_id", "pattern").alias("n_entries"), F.min("pattern").alias("pattern"))
    return captures.join(found, "capture_id", "left").select(*captures.columns, F.col("n_entries").isNotNull().alias("blocked"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), "pattern")
