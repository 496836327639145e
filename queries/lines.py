"""Filters, extraction, projection and lookups over lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from linespark.functions import predicates as P
from linespark.functions import scalars as X
from linespark.functions.extract import capture, extract_fields
from linespark.operators import aggregate, joins, project, sample, sections, setops

from .adapters import (DOC_LINES, EVENT_SECTIONS, LINES, TURNS, doc_lines, event_lines, event_sections, table, turn_lines,
                       turn_sections, with_events, with_lines)
from .registry import query

KEY = "source_id, line_num"


@query("flagship", with_lines("""
SELECT tag, ts_ns - ts_ns % 3600000000000 AS bucket, count(*) AS n FROM lines
WHERE level_ord >= 2 AND (starts_with(tag, 'error') OR starts_with(tag, 'purchase')) AND cents > 1000 GROUP BY 1, 2"""))
def flagship(spark, sf):
    x = event_lines(spark, sf).filter(P.all_of(P.level_min("I"), P.tag_prefix("error", "purchase")))
    x = extract_fields(x, {"cents": (r"cents=(\d+)", "int")}).filter("cents > 1000")
    return aggregate.count_by_time_grouped(project.emit(x, tag=F.col("tag"), cents=F.col("cents")), "1h", "tag")


@query("extract_fields", with_lines("""
SELECT source_id, line_num, cents, k, nullif(regexp_extract(message, 'user=(9\\d*)', 1), '') AS nine,
       CAST(NULL AS VARCHAR) AS absent FROM lines"""))
def extract_fields_q(spark, sf):
    return extract_fields(event_lines(spark, sf), {
        "cents": (r"cents=(\d+)", "int"), "k": (r"k=(-?\d+)", "int"), "nine": r"user=(9\d*)", "absent": r"nothing=(\w+)"}).select(
        "source_id", "line_num", "cents", "k", "nine", "absent")


@query("capture_groups", with_lines("""
SELECT source_id, line_num, regexp_extract(tag, '^(\\w)(\\w+)', 1) AS cap_1, regexp_extract(tag, '^(\\w)(\\w+)', 2) AS cap_2,
       regexp_extract(message, 'user=(\\d+) cents=(\\d+)', 1) AS cap_3, regexp_extract(message, 'user=(\\d+) cents=(\\d+)', 2) AS cap_4
FROM lines"""))
def capture_groups(spark, sf):
    return capture(event_lines(spark, sf), r"^(\w)(\w+)", r"user=(\d+) cents=(\d+)").select(
        "source_id", "line_num", "cap_1", "cap_2", "cap_3", "cap_4")


@query("rewrite_fields", with_lines("""
SELECT source_id, line_num, regexp_replace(message, '\\d+', '#', 'g') AS message, 'shop' AS origin, tag AS kind, tag AS label FROM lines"""))
def rewrite_fields(spark, sf):
    x = project.replace_field(event_lines(spark, sf), "message", r"\d+", "#")
    x = project.set_field(x, "origin", "shop")
    x = project.add_field(x, "kind", F.col("tag"))
    x = project.with_fields(x, label=F.col("tag"))
    return project.drop_field(x, "raw").select("source_id", "line_num", "message", "origin", "kind", "label")


@query("emit_rows", with_lines("""
SELECT source_id, line_num, ts_ns, 'cents' AS what, cents AS amount FROM lines WHERE tag = 'purchase'
UNION ALL SELECT source_id, line_num, ts_ns, 'k', k FROM lines WHERE tag = 'purchase' AND k > 50"""))
def emit_rows(spark, sf):
    x = extract_fields(event_lines(spark, sf).filter("tag = 'purchase'"), {"cents": (r"cents=(\d+)", "int")})
    both = project.emit_many(x, [{"what": F.lit("cents"), "amount": F.col("cents")},
                                 {"what": F.lit("k"), "amount": F.col("tid").cast("bigint")}])
    return both.filter("what = 'cents' OR amount > 50")


@query("table_view", with_lines("SELECT line_num, level, tag FROM lines ORDER BY line_num DESC"))
def table_view(spark, sf):
    return project.table_view(event_lines(spark, sf), ["line_num", "level", "tag"], "line_num", True)


@query("highlight_spans", with_lines("""
SELECT source_id, line_num, CAST(i AS INTEGER) AS start_at, CAST(i + 1 AS INTEGER) AS end_at FROM (
  SELECT source_id, line_num, raw, unnest(range(length(raw))) AS i FROM lines) WHERE lower(substr(raw, i + 1, 1)) = 'e'"""))
def highlight_spans(spark, sf):
    x = project.highlight_spans(event_lines(spark, sf).select("source_id", "line_num", "raw"), "E")
    return x.select("source_id", "line_num", F.inline("spans").alias("start_at", "end_at"))


@query("highlight_spans_regex", with_lines("""
SELECT source_id, line_num, strpos(raw, ' cents=') + 6 AS start_at, strpos(raw, ' cents=') + 6 + length(CAST(cents AS VARCHAR)) AS end_at
FROM lines"""))
def highlight_spans_regex(spark, sf):
    x = project.highlight_spans(event_lines(spark, sf).select("source_id", "line_num", "raw"), r"(?<=cents=)\d+", is_regex=True)
    return x.select("source_id", "line_num", F.inline("spans").alias("start_at", "end_at"))


@query("truncate_text", f"""WITH {DOC_LINES}
SELECT source_id, line_num, CASE WHEN length(message) > 40 THEN substr(message, 1, 40) || '...' ELSE message END AS text FROM doc_lines""")
def truncate_text(spark, sf):
    return doc_lines(spark, sf).select("source_id", "line_num", X.truncate_text("message", 40).alias("text"))


@query("render_template", with_lines("""
SELECT source_id, line_num, tag || ' by ' || pid || ' is ' || coalesce(nullif(regexp_extract(message, 'user=(9\\d*)', 1), ''), '<unknown>')
  || ' / <unknown>' AS text FROM lines"""))
def render_template(spark, sf):
    x = extract_fields(event_lines(spark, sf), {"nine": r"user=(9\d*)"})
    return project.rendered(x, "{{tag}} by {{pid}} is {{nine}} / {{no_such}}").select("source_id", "line_num", "text")


@query("rule_filter", with_lines("""
SELECT source_id, line_num FROM lines WHERE level_ord >= 3 AND (starts_with(tag, 'err') OR starts_with(tag, 'pur'))
  AND contains(message, 'user=1') AND (contains(message, 'k=1') OR contains(message, 'k=2'))"""))
def rule_filter(spark, sf):
    return event_lines(spark, sf).filter(P.all_of(
        P.level_min("W"), P.tag_prefix("err", "pur"), P.message_contains("user=1"), P.message_contains_any("k=1", "k=2"))).select("source_id", "line_num")


@query("regex_filter", with_lines("""
SELECT source_id, line_num FROM lines WHERE regexp_matches(tag, '^(view|click)$') AND regexp_matches(message, 'cents=\\d*[05] k=\\d$')"""))
def regex_filter(spark, sf):
    return project.filter_lines(event_lines(spark, sf), P.tag_regex("^(view|click)$"), P.message_regex(r"cents=\d*[05] k=\d$")).select(
        "source_id", "line_num")


@query("time_of_day", with_lines("""
SELECT source_id, line_num FROM lines WHERE ts_ns % 86400000000000 BETWEEN 30 * 60000000000 AND 120 * 60000000000"""))
def time_of_day(spark, sf):
    return event_lines(spark, sf).filter(P.time_of_day("00:30", "02:00")).select("source_id", "line_num")


@query("source_type_is", with_lines("""
SELECT source_id, line_num, source_id = '0' AS kernel FROM lines WHERE source_id != '1'"""))
def source_type_is(spark, sf):
    """Sources of three kinds."""
    kind = F.when(F.col("source_id") == "0", "Kernel").when(F.col("source_id") == "1", "Bugreport").otherwise("Logcat")
    x = event_lines(spark, sf).withColumn("source_type", kind)
    return x.filter(P.source_type_is("LOGCAT") | P.source_type_is("kernel")).select("source_id", "line_num", P.source_type_is("KERNEL").alias("kernel"))


@query("criteria_and", with_lines("""
SELECT source_id, line_num FROM lines WHERE contains(lower(raw), 'user=2') AND regexp_matches(raw, 'k=[1-5]') AND level_ord IN (1, 4)
  AND (contains(tag, 'lic') OR contains(tag, 'rro')) AND ts_ns >= 1704499200000000000 AND ts_ns <= 1706000000000000000 AND pid IN (2, 20, 21, 25)"""))
def criteria_and(spark, sf):
    return event_lines(spark, sf).filter(P.criteria(
        text="USER=2", regex="k=[1-5]", levels=["D", "Error"], tags=["LIC", "rro"], time_start=1704499200000000000,
        time_end=1706000000000000000, pids=[2, 20, 21, 25])).select("source_id", "line_num")


@query("criteria_or", with_lines("""
SELECT source_id, line_num FROM lines WHERE contains(raw, 'k=77') OR level_ord = 4 OR pid = 3 OR ts_ns <= 1704100000000000000"""))
def criteria_or(spark, sf):
    return event_lines(spark, sf).filter(P.criteria(text="k=77", levels=["E"], tags=[], pids=[3], time_end=1704100000000000000,
                                                    combine="or")).select("source_id", "line_num")


@query("line_expressions", with_lines("""
SELECT source_id, line_num FROM lines WHERE (contains(tag, 'sign') OR (level = 'Error' AND NOT contains(message, 'k=4')))
  AND (pid = 5 OR tid = 9 OR contains(raw, 'user=11') OR contains(message, 'cents=12'))"""))
def line_expressions(spark, sf):
    cond = (P.tag_has("SIGN") | (P.level_eq("Error") & ~P.message_has("K=4"))) & (
        P.pid_eq(5) | P.tid_eq(9) | P.text_any("USER=11") | P.message_has("cents=12"))
    return event_lines(spark, sf).filter(cond).select("source_id", "line_num")


@query("pid_in_package", with_lines("""
SELECT l.source_id, l.line_num FROM lines l WHERE EXISTS (
  SELECT 1 FROM customer c WHERE c.c_mktsegment = 'MACHINERY' AND c.c_custkey = l.pid)"""))
def pid_in_package(spark, sf):
    c = table(spark, sf, "customer")
    pids = c.select((F.col("c_custkey") % 4).cast("string").alias("source_id"), F.col("c_custkey").cast("int").alias("pid"),
                    F.col("c_mktsegment").alias("package"))
    return joins.pid_in_package(event_lines(spark, sf), pids, "MACHINERY").select("source_id", "line_num")


@query("search", with_lines("""
SELECT source_id, line_num FROM lines WHERE regexp_matches(raw, '(?i)USER=1[0-9] .*k=[5-9]') AND level_ord >= 2
  AND tag IN ('error', 'signup') AND ts_ns % 86400000000000 BETWEEN 6 * 3600000000000 AND 18 * 3600000000000"""))
def search(spark, sf):
    return sample.search(event_lines(spark, sf), "USER=1[0-9] .*k=[5-9]", is_regex=True, min_level="I", tags=["error", "signup"],
                         start_time="06:00", end_time="18:00:00").select("source_id", "line_num")


@query("ranges", with_lines("""
SELECT source_id, line_num FROM lines WHERE line_num >= 100 AND line_num < 700 AND ts_ns BETWEEN 1704100000000000000 AND 1705500000000000000"""))
def ranges(spark, sf):
    return event_lines(spark, sf).filter(P.line_range(100, 700) & P.ts_between(1704100000000000000, 1705500000000000000)).select("source_id", "line_num")


@query("condition", with_lines("""
SELECT source_id, line_num FROM lines WHERE (nullif(regexp_extract(message, 'user=(9\\d*)', 1), '') IS NOT NULL
  AND regexp_extract(message, 'user=(9\\d*)', 1) != '9') OR cents > 45000"""))
def condition(spark, sf):
    x = extract_fields(event_lines(spark, sf), {"nine": r"user=(9\d*)", "cents": r"cents=(\d+)"})
    return x.filter(P.condition(F.col("nine") != "9") | P.condition(X.num("cents") > 45000)).select("source_id", "line_num")


@query("with_section", f"""WITH {LINES}, {EVENT_SECTIONS}, r AS (
  SELECT l.source_id, l.line_num, max(s.start_line) AS st FROM lines l LEFT JOIN sections s
  ON l.source_id = s.source_id AND s.start_line <= l.line_num GROUP BY 1, 2)
SELECT r.source_id, r.line_num, CASE WHEN r.line_num <= s.end_line THEN s.name END AS section
FROM r LEFT JOIN sections s ON r.source_id = s.source_id AND r.st = s.start_line""")
def with_section(spark, sf):
    return sections.with_section(event_lines(spark, sf), event_sections(spark, sf)).select("source_id", "line_num", "section")


@query("section_is", f"""WITH {TURNS}
SELECT t.source_id, t.line_num FROM t JOIN sections s ON t.source_id = s.source_id AND t.line_num BETWEEN s.start_line AND s.end_line
  AND NOT EXISTS (SELECT 1 FROM sections z WHERE z.source_id = s.source_id AND z.start_line > s.start_line AND z.start_line <= t.line_num)
WHERE s.name = 'SECTION 1'""")
def section_is(spark, sf):
    x = sections.with_section(turn_lines(spark, sf), turn_sections(spark, sf))
    return x.filter(P.section_is("SECTION 1")).select("source_id", "line_num")


@query("in_sections", f"""WITH {LINES}, {EVENT_SECTIONS}
SELECT l.source_id, l.line_num FROM lines l WHERE EXISTS (SELECT 1 FROM sections s WHERE s.source_id = l.source_id
  AND s.name IN ('error', 'view') AND l.line_num BETWEEN s.start_line AND s.end_line)
  OR NOT EXISTS (SELECT 1 FROM sections s WHERE s.source_id = l.source_id AND s.name IN ('error', 'view'))""")
def in_sections(spark, sf):
    return sections.in_sections(event_lines(spark, sf), event_sections(spark, sf), ["error", "view"]).select("source_id", "line_num")


@query("containing_sections", f"""WITH {TURNS}
SELECT t.source_id, t.line_num, s.section_idx,
  row_number() OVER (PARTITION BY t.source_id, t.line_num ORDER BY s.start_line, s.section_idx) - 1 AS depth
FROM t JOIN sections s ON t.source_id = s.source_id AND t.line_num BETWEEN s.start_line AND s.end_line""")
def containing_sections(spark, sf):
    return sections.containing_sections(turn_lines(spark, sf), turn_sections(spark, sf)).select("source_id", "line_num", "section_idx", "depth")


@query("filter_sections", f"""WITH {TURNS}, hit AS (SELECT * FROM sections WHERE contains(lower(name), 'n 2'))
SELECT source_id, section_idx, name FROM sections s WHERE (source_id, section_idx) IN (SELECT source_id, section_idx FROM hit)
  OR (source_id, section_idx) IN (SELECT source_id, parent_index FROM hit WHERE parent_index IS NOT NULL)
  OR (source_id, parent_index) IN (SELECT source_id, section_idx FROM hit WHERE parent_index IS NULL)""")
def filter_sections(spark, sf):
    return sections.filter_sections(turn_sections(spark, sf), "N 2").select("source_id", "section_idx", "name")


@query("section_groups", f"""WITH {LINES}, g0 AS (
  SELECT source_id, CASE WHEN tag IN ('error', 'view', 'click') THEN 'SHOW MAP ' ELSE 'ROUTE ' END AS prefix, line_num,
    row_number() OVER (PARTITION BY source_id ORDER BY line_num) AS i FROM lines),
g1 AS (SELECT *, i - row_number() OVER (PARTITION BY source_id, prefix ORDER BY line_num) AS run FROM g0)
SELECT source_id, prefix, count(*) AS sections, min(line_num) AS start_line, max(line_num) AS end_line, count(*) AS total_lines
FROM g1 GROUP BY source_id, prefix, run HAVING count(*) >= 5""")
def section_groups(spark, sf):
    x = event_lines(spark, sf)
    name = F.when(F.col("tag").isin("error", "view", "click"), F.concat(F.lit("SHOW MAP "), "line_num")).otherwise(
        F.concat(F.lit("ROUTE "), "line_num"))
    secs = x.select("source_id", F.col("line_num").cast("int").alias("section_idx"), name.alias("name"),
                    F.col("line_num").alias("start_line"), F.col("line_num").alias("end_line"), F.lit(None).cast("int").alias("parent_index"))
    return sections.section_groups(secs)


@query("attach_text", with_lines("SELECT source_id, line_num, substr(raw, 1, 20) || '...' AS text FROM lines WHERE tag = 'error'"))
def attach_text(spark, sf):
    x = event_lines(spark, sf)
    return joins.attach_text(x.filter("tag = 'error'").select("source_id", "line_num"), x, 20)


@query("with_context", f"""WITH {LINES}, m AS (SELECT source_id, line_num FROM lines WHERE contains(raw, 'k=42'))
SELECT l.source_id, l.line_num, bool_or(m.line_num = l.line_num) AS is_match FROM lines l JOIN m
ON l.source_id = m.source_id AND l.line_num BETWEEN m.line_num - 8 AND m.line_num + 8 GROUP BY 1, 2""")
def with_context(spark, sf):
    x = event_lines(spark, sf)
    return joins.with_context(x.filter(F.col("raw").contains("k=42")), x, 8).select("source_id", "line_num", "is_match")


@query("lines_around", with_lines("""
SELECT source_id, line_num, line_num = 500 AS is_center FROM lines WHERE line_num BETWEEN 500 - 25 AND 500 + 60"""))
def lines_around(spark, sf):
    return joins.lines_around(event_lines(spark, sf), 500, 5, 60, floor=25).select("source_id", "line_num", "is_center")


@query("with_annotations", f"""WITH {LINES}, a AS (SELECT source_id, 'note ' || line_num AS label, line_num AS start_line,
  CASE WHEN line_num % 2 = 0 THEN line_num + 20 ELSE line_num END AS end_line FROM lines WHERE tag = 'signup' AND k = 7)
SELECT l.source_id, l.line_num, a.label FROM lines l JOIN a ON l.source_id = a.source_id AND l.line_num BETWEEN a.start_line AND a.end_line""")
def with_annotations(spark, sf):
    x = event_lines(spark, sf)
    marks = x.filter("tag = 'signup' AND tid = 7").select(
        "source_id", F.concat(F.lit("note "), "line_num").alias("label"), F.col("line_num").alias("start_line"),
        F.when(F.col("line_num") % 2 == 0, F.col("line_num") + 20).alias("end_line"))
    return joins.with_annotations(x, marks).select("source_id", "line_num", "label")


@query("matched_by", with_lines("""
SELECT source_id, line_num, concat_ws(',', CASE WHEN level_ord >= 4 THEN 'bad' END, CASE WHEN cents > 30000 THEN 'big' END,
  CASE WHEN pid < 5 THEN 'few' END) AS jobs FROM lines"""))
def matched_by(spark, sf):
    x = event_lines(spark, sf)
    y = extract_fields(x, {"cents": (r"cents=(\d+)", "int")})
    out = joins.matched_by(x, {"bad": x.filter(P.level_min("E")), "big": y.filter("cents > 30000"), "few": x.filter("pid < 5")})
    return out.select("source_id", "line_num", F.concat_ws(",", "matched_by").alias("jobs"))


@query("union_matches", with_lines("SELECT DISTINCT source_id, line_num FROM lines WHERE level_ord >= 4 OR pid < 5"))
def union_matches(spark, sf):
    x = event_lines(spark, sf)
    return setops.union_matches(x.filter(P.level_min("E")), x.filter("pid < 5"))


@query("matched_lines", with_lines("SELECT source_id, line_num, raw AS text FROM lines WHERE pid < 5"))
def matched_lines(spark, sf):
    x = event_lines(spark, sf)
    return setops.matched_lines(project.emit(x.filter("pid < 5"), tag=F.col("tag")), x)


@query("scalar_functions", with_lines("""
SELECT source_id, line_num, length(message) AS len, upper(tag) AS up, CASE WHEN cents >= 30000 THEN 'high' WHEN cents >= 10000 THEN 'mid' ELSE 'low' END AS size,
  cents * 100 // (cents + k + 1) AS pct, ts_ns - ts_ns % 300000000000 AS bucket, 'shop.example' AS host,
  CAST(pid AS VARCHAR) AS last_part, ((1 * 60 + 2) * 60 + k) * 1000 + 5 AS clock_ms,
  lpad(CAST(ts_ns // 3600000000000 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ts_ns // 60000000000 % 60 AS VARCHAR), 2, '0') || ':'
  || lpad(CAST(ts_ns // 1000000000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ts_ns // 1000000 % 1000 AS VARCHAR), 3, '0') AS clock,
  ts_ns // 1000000000 * 1000000000 AS parsed_ns FROM lines"""))
def scalar_functions(spark, sf):
    x = extract_fields(event_lines(spark, sf), {"cents": (r"cents=(\d+)", "int")})
    c, k = F.col("cents"), F.col("tid").cast("bigint")
    iso = F.concat(F.date_from_unix_date(F.floor(F.col("ts_ns") / (86400 * 10**9)).cast("int")).cast("string"), F.lit(" "),
                   F.substring(X.timestamp_text("ts_ns"), 1, 8))
    return x.select("source_id", "line_num", F.length("message").alias("len"), F.upper("tag").alias("up"),
                    X.classify(c, [(30000, "high"), (10000, "mid")], "low").alias("size"), X.percent(c, c + k + 1).alias("pct"),
                    X.bucket_floor("ts_ns", "5m").alias("bucket"),
                    X.host_of(F.concat(F.lit("https://me:x@shop.example:81/a?u="), "pid")).alias("host"),
                    X.after_last_slash(F.concat(F.lit("a/b/"), "pid")).alias("last_part"),
                    X.hms_ms(F.lit(1), F.lit(2), k, F.lit(5)).alias("clock_ms"), X.timestamp_text("ts_ns").alias("clock"),
                    X.text_ts_ns(iso, 2024).alias("parsed_ns"))


@query("duration_text", with_lines("""
, d AS (SELECT source_id, line_num, line_num * line_num // 7 * 100 AS ms FROM lines)
SELECT source_id, line_num, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN (ms // 1000) || '.' || (ms % 1000 // 100) || 's'
  WHEN ms < 3600000 THEN (ms // 60000) || 'm ' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || 's'
  ELSE (ms // 3600000) || 'h ' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || 'm' END AS shown FROM d"""))
def duration_text(spark, sf):
    ms = F.expr("line_num * line_num div 7 * 100")
    return event_lines(spark, sf).select("source_id", "line_num", X.duration_text(ms, "ms").alias("shown"))


@query("map_lines", with_lines("SELECT source_id, line_num, length(message) - length(replace(message, '=', '')) AS n FROM lines WHERE tag = 'error'"))
def map_lines(spark, sf):
    def count(frames):
        for f in frames:
            yield f[["source_id", "line_num"]].assign(n=f["message"].str.count("="))
    return project.map_lines(event_lines(spark, sf).filter("tag = 'error'"), count, "source_id string, line_num bigint, n bigint")


@query("fold_lines", with_lines("""
, g AS (SELECT *, lag(cents, 1, 0) OVER (PARTITION BY source_id, pid ORDER BY line_num) AS before FROM lines)
SELECT source_id, pid, CAST(sum(abs(cents - before)) AS BIGINT) AS moved FROM g GROUP BY 1, 2"""))
def fold_lines(spark, sf):
    """How far the amounts of each user move from line to line."""
    x = extract_fields(event_lines(spark, sf), {"cents": (r"cents=(\d+)", "int")}).select("source_id", "pid", "line_num", "cents")

    def moved(f):
        return f.iloc[:1][["source_id", "pid"]].assign(moved=int(f["cents"].diff().fillna(f["cents"].iloc[0]).abs().sum()))
    return project.fold_lines(x, ["source_id", "pid"], moved, "source_id string, pid int, moved bigint")
