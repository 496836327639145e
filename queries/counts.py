"""Aggregates, charts, insights, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from linespark.functions import predicates as P
from linespark.functions.extract import extract_fields, field
from linespark.operators import aggregate as A
from linespark.operators import charts, project, sample
from linespark.operators.insights import Signal, insights

from .adapters import EVENT_SECTIONS, LINES, event_lines, event_sections, table, with_lines
from .registry import query


def amounts(spark, sf):
    return extract_fields(event_lines(spark, sf), {"cents": (r"cents=(\d+)", "int")})


@query("count_lines", with_lines("SELECT count(*) AS n FROM lines WHERE level_ord >= 3"))
def count_lines(spark, sf):
    return A.count_lines(event_lines(spark, sf).filter(P.level_min("W")))


@query("count_by", with_lines("""
SELECT nine, count(*) AS n FROM (SELECT nullif(regexp_extract(message, 'user=(9\\d*)', 1), '') AS nine FROM lines) WHERE nine IS NOT NULL
GROUP BY 1"""))
def count_by(spark, sf):
    return A.count_by(extract_fields(event_lines(spark, sf), {"nine": r"user=(9\d*)"}), "nine")


@query("count_by_time", with_lines("SELECT ts_ns - ts_ns % 300000000000 AS bucket, count(*) AS n FROM lines GROUP BY 1"))
def count_by_time(spark, sf):
    return A.count_by_time(event_lines(spark, sf), "5m")


@query("count_by_time_grouped", with_lines("SELECT tag, ts_ns - ts_ns % 3600000000000 AS bucket, count(*) AS n FROM lines GROUP BY 1, 2"))
def count_by_time_grouped(spark, sf):
    return A.count_by_time_grouped(event_lines(spark, sf), "1h", "tag")


@query("stats_field", with_lines("""
SELECT CAST(min(c) AS DOUBLE) AS min, CAST(max(c) AS DOUBLE) AS max, round(avg(c), 6) AS mean, count(c) AS n FROM (
  SELECT CASE WHEN pid % 2 = 0 THEN cents END AS c FROM lines)"""))
def stats_field(spark, sf):
    x = amounts(spark, sf).withColumn("c", F.when(F.col("pid") % 2 == 0, F.col("cents").cast("string")).otherwise("junk"))
    return A.stats_field(x, "c").withColumn("mean", F.round("mean", 6))


@query("percentiles", """SELECT event_type, quantile_disc(value, 0.5) AS p50_value, quantile_disc(value, 0.95) AS p95_value, CAST(quantile_disc(event_id, 0.999) AS DOUBLE) AS p100_event_id, count(*) AS count
FROM events GROUP BY 1""")
def percentiles(spark, sf):
    """Exact percentiles of columns whose values are nearly all distinct."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return A.aggregate(e, [("percentile", "value", 0.5), ("percentile", "value", 0.95), ("percentile", "event_id", 0.999), ("count",)], "event_type")


@query("aggregate", with_lines("""
SELECT tag, ts_ns - ts_ns % 86400000000000 AS bucket, count(*) AS count, CAST(min(cents) AS DOUBLE) AS min_cents, CAST(max(cents) AS DOUBLE) AS max_cents,
  round(avg(cents), 6) AS avg_cents, CAST(sum(cents) AS DOUBLE) AS sum_cents, CAST(quantile_disc(cents, 0.9) AS DOUBLE) AS p90_cents
FROM lines GROUP BY 1, 2"""))
def aggregate(spark, sf):
    out = A.aggregate(amounts(spark, sf), [("count",), ("min", "cents"), ("max", "cents"), ("avg", "cents"), ("sum", "cents"),
                                           ("percentile", "cents", 0.9)], "tag", "1d")
    return out.withColumn("avg_cents", F.round("avg_cents", 6))


@query("histogram", with_lines("""
, r AS (SELECT min(cents) / 1.0 AS lo, (max(cents) - min(cents)) / 20.0 AS w FROM lines),
b AS (SELECT least(greatest(CAST(floor((cents - lo) / w) AS BIGINT), 0), 19) AS bin, count(*) AS n FROM lines, r GROUP BY 1)
SELECT 'cents' AS series, round(lo + w * (i + 0.5), 6) AS x, CAST(coalesce(n, 0) AS DOUBLE) AS y FROM r, range(20) t(i) LEFT JOIN b ON b.bin = i"""))
def histogram(spark, sf):
    return charts.histogram(amounts(spark, sf), "cents").select("series", F.round("x", 6).alias("x"), "y")


@query("histogram_range", with_lines("""
, b AS (SELECT least(greatest(CAST(floor((cents - 10000.0) / 2000.0) AS BIGINT), 0), 9) AS bin, count(*) AS n FROM lines GROUP BY 1)
SELECT 10000 + 2000 * (i + 0.5) AS x, CAST(coalesce(n, 0) AS DOUBLE) AS y FROM range(10) t(i) LEFT JOIN b ON b.bin = i"""))
def histogram_range(spark, sf):
    return charts.histogram(amounts(spark, sf), "cents", 10, (10000, 30000)).select("x", "y")


@query("scatter", with_lines("SELECT CAST(k AS DOUBLE) AS x, CAST(cents AS DOUBLE) AS y FROM lines"))
def scatter(spark, sf):
    return charts.scatter(amounts(spark, sf), "tid", "cents").select("x", "y")


@query("build_charts", with_lines("""
SELECT 'by_tag' AS chart_id, 'count' AS series, CAST(row_number() OVER (ORDER BY count(*) DESC, tag) - 1 AS DOUBLE) AS x,
  CAST(count(*) AS DOUBLE) AS y, tag AS label FROM lines GROUP BY tag
UNION ALL SELECT 'cents_by_tag', 'sum(cents)', row_number() OVER (ORDER BY sum(cents) DESC, tag) - 1, sum(cents), tag FROM lines GROUP BY tag
UNION ALL SELECT 'per_day', level, ts_ns - ts_ns % 86400000000000, count(*), NULL FROM lines GROUP BY level, 3
UNION ALL SELECT 'max_per_day', 'max(cents)', ts_ns - ts_ns % 86400000000000, max(cents), NULL FROM lines GROUP BY 3"""))
def build_charts(spark, sf):
    return charts.build_charts(amounts(spark, sf), [
        charts.Chart("by_tag", "bar", x="tag"), charts.Chart("cents_by_tag", "pie", x="tag", y="cents", agg="sum"),
        charts.Chart("per_day", "time_series", bucket="1d", group_by="level"),
        charts.Chart("max_per_day", "area", bucket="1d", y="cents", agg="max")])


@query("level_distribution", with_lines("SELECT level, count(*) AS n FROM lines GROUP BY 1"))
def level_distribution(spark, sf):
    return A.level_distribution(event_lines(spark, sf))


@query("top_tags", with_lines("SELECT tag, count(*) AS n FROM lines GROUP BY 1 ORDER BY n DESC, tag LIMIT 3"))
def top_tags(spark, sf):
    return A.top_tags(event_lines(spark, sf), 3)


@query("source_metadata", f"""WITH {LINES}, {EVENT_SECTIONS}
SELECT source_id, count(*) AS total_lines, sum(strlen(raw) + 1)::BIGINT AS bytes, arg_min(ts_ns, line_num) AS first_ts_ns, max(ts_ns) AS last_ts_ns,
  (SELECT count(*) FROM sections s WHERE s.source_id = l.source_id) AS sections FROM lines l GROUP BY 1""")
def source_metadata(spark, sf):
    return A.source_metadata(event_lines(spark, sf), event_sections(spark, sf))


@query("search_summary", with_lines("""
SELECT CASE WHEN g = 3 THEN 'total' WHEN g = 1 THEN 'level' ELSE 'tag' END AS kind, CASE WHEN g = 3 THEN '' WHEN g = 1 THEN level ELSE tag END AS key, n
FROM (SELECT level, tag, count(*) AS n, grouping(level, tag) AS g FROM lines WHERE contains(raw, 'k=7') GROUP BY GROUPING SETS ((), (level), (tag)))"""))
def search_summary(spark, sf):
    return A.search_summary(sample.search(event_lines(spark, sf), "K=7"))


@query("summarize", with_lines("""
SELECT source_id, count(*) AS events, count(*) FILTER (tag = 'error') AS errors, sum(cents)::BIGINT AS cents, least(min(cents), 999999) AS smallest,
  greatest(max(cents), 0) AS largest, arg_min(tag, line_num) FILTER (cents = (SELECT max(cents) FROM lines m WHERE m.source_id = l.source_id)) AS largest_tag,
  arg_max(pid, line_num) FILTER (tag = 'signup') AS last_joined, arg_min(pid, line_num) FILTER (tag = 'signup') AS first_joined,
  (sum(cents) // count(*))::BIGINT AS average FROM lines l GROUP BY 1"""))
def summarize(spark, sf):
    joined = F.when(F.col("tag") == "signup", F.col("pid"))
    return A.summarize(amounts(spark, sf), {
        "events": A.counter(), "errors": A.counter(F.col("tag") == "error"), "cents": A.total("cents"),
        "smallest": A.running_min("cents", 999999), "largest": A.running_max("cents", 0), "largest_tag": A.at_max("tag", "cents"),
        "last_joined": A.last_value(joined), "first_joined": A.first_value(joined), "average": A.average(F.sum("cents"), F.count("*"))})


@query("count_and_max_maps", with_lines("""
SELECT source_id, tag AS key, count(*) AS n, max(cents) AS max FROM lines GROUP BY 1, 2"""))
def count_and_max_maps(spark, sf):
    x = amounts(spark, sf)
    return A.count_map(x, "tag").join(A.max_map(x, "tag", "cents"), ["source_id", "key"])


@query("top_map_entries", with_lines("""
, c AS (SELECT source_id, CAST(pid AS VARCHAR) AS key, count(*) AS n FROM lines GROUP BY 1, 2)
SELECT * FROM (SELECT source_id, key, n, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, key) AS position,
  count(*) OVER (PARTITION BY source_id) AS total_keys, count(*) OVER (PARTITION BY source_id) > 20 AS truncated FROM c) WHERE position <= 20"""))
def top_map_entries(spark, sf):
    return A.top_map_entries(A.count_map(event_lines(spark, sf), "pid"))


@query("merge_results", with_lines("""
SELECT source_id, tag AS var, max(line_num) FILTER (line_num >= 300) AS value FROM lines GROUP BY 1, 2
HAVING max(line_num) FILTER (line_num >= 300) IS NOT NULL"""))
def merge_results(spark, sf):
    x = event_lines(spark, sf)
    part = lambda cond, b: x.filter(cond).groupBy("source_id", F.col("tag").alias("var")).agg(F.max("line_num").alias("value")).withColumn("batch", F.lit(b))
    out = A.merge_results({"vars": part("line_num < 300", 0)}, {"vars": part("line_num >= 300", 1)})
    return out["vars"].filter("batch = 1").drop("batch")


@query("run_summary", with_lines("""
SELECT 'errors' AS job, 'reporter' AS kind, count(*) AS n FROM lines WHERE tag = 'error'
UNION ALL SELECT 'buys', 'tracker', count(*) FROM lines WHERE tag = 'purchase'"""))
def run_summary(spark, sf):
    x = event_lines(spark, sf)
    return A.run_summary({"errors": ("reporter", x.filter("tag = 'error'")), "buys": ("tracker", x.filter("tag = 'purchase'"))})


@query("row_errors", with_lines("""
SELECT source_id, count(*) AS matched, count(*) FILTER (k % 10 = 3) AS amount_errors, min(line_num) FILTER (k % 10 = 3) AS amount_first_line
FROM lines GROUP BY 1"""))
def row_errors(spark, sf):
    x = event_lines(spark, sf).withColumn("t", F.when(F.col("tid") % 10 == 3, "oops").otherwise(F.col("tid").cast("string")))
    return project.row_errors(x, {"amount": F.col("t").try_cast("bigint")})


@query("insights", f"""WITH {LINES}, s AS (
  SELECT source_id, 'huge' AS name, 'critical' AS severity, 0 AS sev, 0 AS def, line_num AS line, CAST(NULL AS BIGINT) AS last_line, 'huge: ' || cents AS message
    FROM lines WHERE cents > 48000
  UNION ALL SELECT source_id, 'big', 'warning', 1, 1, line_num, NULL, 'big: ' || cents FROM lines WHERE cents > 47000
  UNION ALL SELECT source_id, 'many', 'info', 2, 2, min(line_num), max(line_num), count(*) || ' events' FROM lines GROUP BY source_id)
SELECT source_id, name, severity, line, last_line, message, signal_count, position, total > 30 AS truncated FROM (
  SELECT *, count(*) OVER (PARTITION BY source_id, name) AS signal_count, count(*) OVER (PARTITION BY source_id) AS total,
    row_number() OVER (PARTITION BY source_id ORDER BY sev, def, line, message) AS position FROM s) WHERE position <= 30""")
def insights_q(spark, sf):
    rows = project.emit(amounts(spark, sf), cents=F.col("cents"))
    summary = A.summarize(rows, {"n": A.counter()})
    return insights(rows, summary, [
        Signal("huge", "critical", F.col("cents") > 48000, message="huge: {{cents}}", fields=("cents",)),
        Signal("big", "warning", F.col("cents") > 47000, message="big: {{cents}}"),
        Signal("many", "info", F.col("n") > 0, "aggregate", message="{{n}} events")], "shop", 30).select(
        "source_id", "name", "severity", "line", "last_line", "message", "signal_count", "position", "truncated")


@query("page", with_lines("""
SELECT source_id, line_num, position FROM (SELECT source_id, line_num, row_number() OVER (PARTITION BY source_id ORDER BY line_num) - 1 AS position
  FROM lines WHERE tag = 'click') WHERE position BETWEEN 100 AND 149"""))
def page(spark, sf):
    return sample.page(event_lines(spark, sf).filter("tag = 'click'"), 100, 50, 512).select("source_id", "line_num", "position")


@query("sample_uniform", with_lines("""
, r AS (SELECT source_id, line_num, row_number() OVER (PARTITION BY source_id ORDER BY line_num) - 1 AS p, count(*) OVER (PARTITION BY source_id) AS total FROM lines)
SELECT source_id, line_num FROM r WHERE p IN (SELECT i * total // 40 FROM range(40) t(i))"""))
def sample_uniform(spark, sf):
    return sample.sample_uniform(event_lines(spark, sf), 40, contiguous=False).select("source_id", "line_num")


@query("sample_uniform_matches", with_lines("""
, r AS (SELECT source_id, line_num, row_number() OVER (PARTITION BY source_id ORDER BY line_num) - 1 AS p, count(*) OVER (PARTITION BY source_id) AS total FROM lines WHERE tag = 'error')
SELECT source_id, line_num FROM r WHERE p IN (SELECT i * total // 25 FROM range(25) t(i))"""))
def sample_uniform_matches(spark, sf):
    return sample.sample_uniform(event_lines(spark, sf), 25, where=F.col("tag") == "error").select("source_id", "line_num")


@query("sample_recent", with_lines("""
SELECT source_id, line_num FROM lines WHERE tag = 'error' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY line_num DESC) <= 15"""))
def sample_recent(spark, sf):
    return sample.sample_recent(event_lines(spark, sf), 15, F.col("tag") == "error").select("source_id", "line_num")


@query("sample_around", with_lines("""
SELECT source_id, line_num FROM lines WHERE tag = 'error' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY abs(line_num - 450), line_num) <= 12"""))
def sample_around(spark, sf):
    return sample.sample_around(event_lines(spark, sf), 450, 12, F.col("tag") == "error").select("source_id", "line_num")


@query("sample_recent_unfiltered", with_lines("""
SELECT source_id, line_num FROM lines QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY line_num DESC) <= 10"""))
def sample_recent_unfiltered(spark, sf):
    return sample.sample_recent(event_lines(spark, sf), 10).select("source_id", "line_num")


@query("sample_around_unfiltered", with_lines("""
, r AS (SELECT source_id, line_num, row_number() OVER (PARTITION BY source_id ORDER BY line_num) - 1 AS p,
  count(*) FILTER (WHERE line_num < 450) OVER (PARTITION BY source_id) AS c FROM lines)
SELECT source_id, line_num FROM r WHERE p >= greatest(c - 5, 0) AND p < greatest(c - 5, 0) + 10"""))
def sample_around_unfiltered(spark, sf):
    return sample.sample_around(event_lines(spark, sf), 450, 10).select("source_id", "line_num")


@query("sample_recent_rare_matches", """
SELECT CAST(l_suppkey % 2 AS VARCHAR) AS source_id, l_orderkey * 8 + l_linenumber AS line_num FROM lineitem WHERE l_quantity = 50
QUALIFY row_number() OVER (PARTITION BY l_suppkey % 2 ORDER BY l_orderkey * 8 + l_linenumber DESC) <= 2000""")
def sample_recent_rare_matches(spark, sf):
    items = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 2).cast("string").alias("source_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_num"), "l_quantity")
    return sample.sample_recent(items, 2000, F.col("l_quantity") == 50).select("source_id", "line_num")


@query("digest", with_lines("""
SELECT source_id, line_num FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY line_num) - 1 AS p, count(*) OVER (PARTITION BY source_id) AS total FROM lines)
WHERE p < 40 OR (p >= total // 2 - 20 AND p < total // 2 + 20) OR p >= total - 40"""))
def digest(spark, sf):
    return sample.digest(event_lines(spark, sf)).select("source_id", "line_num")


@query("search_with_context", with_lines("""
, h AS (SELECT source_id, line_num, row_number() OVER (PARTITION BY source_id ORDER BY line_num) AS p, count(*) OVER (PARTITION BY source_id) AS total
  FROM lines WHERE regexp_matches(raw, 'k=9[0-4]')),
g AS (SELECT * FROM h WHERE p BETWEEN 6 AND 15)
SELECT l.source_id, l.line_num, bool_or(l.line_num = g.line_num) AS is_match, any_value(g.total) AS total_matches FROM lines l JOIN g
ON l.source_id = g.source_id AND l.line_num BETWEEN g.line_num - 3 AND g.line_num + 3 GROUP BY 1, 2"""))
def search_with_context(spark, sf):
    return sample.search_with_context(event_lines(spark, sf), "k=9[0-4]", 10, 3, 5).select("source_id", "line_num", "is_match", "total_matches")


@query("search_captures", with_lines("""
SELECT source_id, line_num, regexp_extract(raw, 'user=(\\d+) cents=(\\d+)', 1) || '/' || regexp_extract(raw, 'user=(\\d+) cents=(\\d+)', 2) AS parts
FROM lines WHERE regexp_matches(raw, 'user=(\\d+) cents=(\\d+)')"""))
def search_captures(spark, sf):
    out = sample.search_captures(event_lines(spark, sf), r"user=(\d+) cents=(\d+)")
    return out.select("source_id", "line_num", F.array_join("captures", "/").alias("parts"))


@query("latest", with_lines("""
SELECT source_id, tag, line_num FROM lines QUALIFY row_number() OVER (PARTITION BY source_id, tag ORDER BY line_num DESC) <= 3"""))
def latest(spark, sf):
    return sample.latest(event_lines(spark, sf).select("source_id", "tag", "line_num"), 3, ("source_id", "tag"))


@query("rank_map", with_lines("SELECT source_id, tag AS key, count(*) AS n FROM lines GROUP BY 1, 2 ORDER BY n DESC, key"))
def rank_map(spark, sf):
    return A.rank_map(A.count_map(event_lines(spark, sf), "tag"))
