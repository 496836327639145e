"""PII over the documents, and parsing of lines rendered from the events."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from linespark.functions.scalars import timestamp_text
from linespark.operators import pii
from linespark.operators.ordered import ensure_checkpoint_dir
from linespark.operators.sections import build_sections, with_section
from linespark.sources import parse, text

from .adapters import DOC_LINES, LINES, doc_lines, event_lines, with_lines
from .registry import query

TWO = ("EMAIL", "IPv4")
EMAIL_RE = r"\b[A-Za-z0-9][A-Za-z0-9_.%+-]{0,62}@[A-Za-z][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,10}\b"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_RE = rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"

SPANS = f"""{DOC_LINES}, found AS (
  SELECT source_id, line_num, message, 'EMAIL' AS category, unnest(list_filter(regexp_extract_all(message, '{EMAIL_RE}'), lambda x: regexp_matches(x, '@[a-z]'))) AS raw FROM doc_lines
  UNION ALL SELECT source_id, line_num, message, 'IPv4', unnest(regexp_extract_all(message, '{IPV4_RE}')) FROM doc_lines)"""


@query("detect_pii", f"WITH {SPANS} SELECT source_id, line_num, category, raw FROM found")
def detect_pii(spark, sf):
    return pii.detect_pii(doc_lines(spark, sf), categories=TWO).select("source_id", "line_num", "category", "raw")


@query("detect_pii_all_categories")
def detect_pii_all(spark, sf):
    return pii.detect_pii(doc_lines(spark, sf), categories=tuple(pii.DETECTORS), custom={"PII": r"\bcustomer-[0-9]+\b"})


@query("assign_tokens", f"""WITH {SPANS}, f AS (SELECT category, raw, min({{'s': source_id, 'l': line_num, 'p': strpos(message, raw)}}) AS place FROM found GROUP BY 1, 2)
SELECT raw, category, n, '<' || category || '-' || n || '>' AS token FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY place, raw) AS n FROM f)""")
def assign_tokens(spark, sf):
    return pii.assign_tokens(pii.detect_pii(doc_lines(spark, sf), categories=TWO))


@query("mask_text", f"""WITH {DOC_LINES}
SELECT source_id, line_num, regexp_replace(regexp_replace(message, '{EMAIL_RE}', '<EMAIL>', 'g'), '{IPV4_RE}', '<IPv4>', 'g') AS message FROM doc_lines""")
def mask_text(spark, sf):
    masked, _ = pii.mask_lines(doc_lines(spark, sf).select("source_id", "line_num", "message"), categories=TWO)
    return masked.withColumn("message", F.regexp_replace("message", r"<(EMAIL|IPv4)-\d+>", "<$1>"))


@query("mask_and_reveal", f"""WITH {DOC_LINES} SELECT source_id, line_num, message,
  len(list_filter(regexp_extract_all(message, '{EMAIL_RE}'), lambda x: regexp_matches(x, '@[a-z]'))) > 0 OR regexp_matches(message, '{IPV4_RE}') AS hidden FROM doc_lines""")
def mask_and_reveal(spark, sf):
    """Lines masked and revealed again; ``hidden`` says whether the mask had changed the line."""
    masked, tokens = pii.mask_lines(doc_lines(spark, sf).select("source_id", "line_num", "message"), categories=TWO)
    back = pii.unmask(masked.withColumn("veiled", F.col("message")), tokens)
    return back.select("source_id", "line_num", "message", (F.col("veiled") != F.col("message")).alias("hidden"))


@query("mask_for", f"""WITH {DOC_LINES}
SELECT source_id, line_num, CASE WHEN CAST(source_id AS BIGINT) % 3 = 0 THEN message ELSE regexp_replace(message, '{IPV4_RE}', '<IPv4>', 'g') END AS message
FROM doc_lines""")
def mask_for(spark, sf):
    x = doc_lines(spark, sf).select("source_id", "line_num", "message")
    flags = x.select("source_id").distinct().filter("source_id % 3 < 2").withColumn("mask", F.col("source_id") % 3 == 1)
    out = pii.mask_for(x, flags, "message", categories=("IPv4",))
    return out.withColumn("message", F.regexp_replace("message", r"<IPv4-\d+>", "<IPv4>"))


@query("pii_report", f"WITH {SPANS} SELECT category, count(*) AS spans, count(DISTINCT raw) AS distinct_values FROM found GROUP BY 1")
def pii_report(spark, sf):
    return pii.pii_report(pii.detect_pii(doc_lines(spark, sf), categories=TWO))


# -- rendered log formats --------------------------------------------------------------------------

def clock(ns: Column) -> Column:
    """``MM-DD HH:MM:SS.mmm``."""
    day = F.date_from_unix_date(F.floor(ns / (86_400 * 10**9)).cast("int")).cast("string")
    return F.concat(F.substring(day, 6, 5), F.lit(" "), timestamp_text(ns))


def raw_lines(spark, sf, raw: Column) -> DataFrame:
    # A generated column is computed once, however often the parser mentions it.
    return event_lines(spark, sf).select("source_id", "line_num", F.explode(F.array(raw)).alias("raw"))


def _logcat_text() -> Column:
    k = F.col("tid") % 5
    head = clock(F.col("ts_ns"))
    lvl = F.substring("level", 1, 1)
    full = F.concat(head, F.lit("  "), F.col("pid") + 100, F.lit("  "), F.col("tid") + 200, F.lit(" "), lvl, F.lit(" "), "tag", F.lit(" : "), "message")
    uid = F.concat(head, F.lit(" u0_a12 "), F.col("pid") + 100, F.lit(" "), F.col("tid") + 200, F.lit(" "), lvl, F.lit(" "), "tag", F.lit(": "), "message")
    brief = F.concat(lvl, F.lit("/"), "tag", F.lit("( "), "pid", F.lit("): "), "message")
    return (F.when(k == 0, full).when(k == 1, uid).when(k == 2, brief).when(k == 3, F.lit("--------- beginning of main")).otherwise(F.col("message")))


@query("parse_logcat", with_lines("""
SELECT source_id, line_num, CASE WHEN k % 5 < 2 THEN ts_ns // 1000000 * 1000000 END AS ts_ns, CASE WHEN k % 5 < 3 THEN level ELSE 'Info' END AS level,
  CASE WHEN k % 5 < 3 THEN tag ELSE '' END AS tag, CASE WHEN k % 5 < 2 THEN pid + 100 WHEN k % 5 = 2 THEN pid ELSE 0 END AS pid,
  CASE WHEN k % 5 < 2 THEN k + 200 ELSE 0 END AS tid, message FROM lines WHERE k % 5 != 3"""))
def parse_logcat(spark, sf):
    return parse.parse_logcat(raw_lines(spark, sf, _logcat_text()), 2024).select(
        "source_id", "line_num", "ts_ns", "level", "tag", "pid", "tid", "message")


@query("parse_threadtime", with_lines("""
SELECT source_id, line_num, ts_ns // 1000000 * 1000000 AS ts_ns, level_ord, pid + 100 AS pid, message FROM lines WHERE k % 5 < 2"""))
def parse_threadtime(spark, sf):
    return parse.parse_threadtime(raw_lines(spark, sf, _logcat_text()), 2024).select(
        "source_id", "line_num", "ts_ns", "level_ord", "pid", "message")


@query("parse_kernel", with_lines("""
SELECT source_id, line_num, 1000 + line_num * 1000000000 + cents * 1000 AS ts_ns, CASE WHEN k % 3 = 0 THEN 2 ELSE [5, 5, 4, 4, 3, 2, 2, 1][k % 8 + 1] END AS level_ord,
  CASE WHEN k % 2 = 0 THEN 'fn' || k ELSE 'kernel' END AS tag, message FROM lines WHERE tag != 'view'"""))
def parse_kernel(spark, sf):
    k = F.col("tid")
    frac = F.lpad(F.regexp_extract("message", r"cents=(\d+)", 1), 6, "0")
    prio = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("<"), k, F.lit(">")))
    fn = F.when(k % 2 == 0, F.concat(F.lit("(fn"), k, F.lit(") "))).otherwise("")
    raw = F.concat(prio, F.lit("["), F.lpad(F.col("line_num").cast("string"), 8, " "), F.lit("."), frac, F.lit("] "), fn, F.col("message"))
    return parse.parse_kernel(raw_lines(spark, sf, F.when(F.col("tag") == "view", F.col("message")).otherwise(raw)), 1000).select(
        "source_id", "line_num", "ts_ns", "level_ord", "tag", "message")


CAPTURED = "2024-01-20 00:00:00"


def bugreport_lines(spark, sf) -> DataFrame:
    """All events as one capture: a header line, sections of 61 lines every 97, service dumps inside the first of five."""
    n = F.col("line_num")
    j, r = F.expr("line_num div 97"), n % 97
    name = F.when(j % 5 == 0, "DUMPSYS NORMAL").otherwise(F.concat(F.lit("SEC"), j % 5))
    log = F.concat(clock(F.col("ts_ns")), F.lit("  10  20 I "), "tag", F.lit(": "), "message")
    text_ = (F.when(n == 1, f"== dumpstate: {CAPTURED}")
             .when(r == 0, F.concat(F.lit("------ "), name, F.lit(" (some/path) ------")))
             .when(r == 60, F.concat(F.lit("------ 0.011s was the duration of '"), name, F.lit("' ------")))
             .when((r == 10) | (r == 30), F.concat(F.lit("DUMP OF SERVICE HIGH svc"), r, F.lit(":")))
             .when(r == 70, "====").otherwise(log))
    return raw_lines(spark, sf, text_).withColumn("source_id", F.lit("all"))


SECTIONS = """n AS (SELECT count(*) AS n FROM events), j AS (SELECT CAST(i AS BIGINT) AS j FROM n, range(n // 97 + 1) t(i) WHERE i * 97 + 60 < n),
tops AS (SELECT CASE WHEN j % 5 = 0 THEN 'DUMPSYS NORMAL' ELSE 'SEC' || (j % 5) END AS name, j * 97 AS s, j * 97 + 60 AS e, NULL AS parent FROM j),
kids AS (SELECT 'svc10' AS name, j * 97 + 10 AS s, j * 97 + 29 AS e, j * 97 AS parent FROM j WHERE j % 5 = 0
  UNION ALL SELECT 'svc30', j * 97 + 30, j * 97 + 60, j * 97 FROM j WHERE j % 5 = 0),
nested AS (SELECT *, row_number() OVER (ORDER BY s, e DESC) - 1 AS idx FROM (SELECT * FROM tops UNION ALL SELECT * FROM kids))"""


@query("build_sections", f"""WITH {SECTIONS}
SELECT b.idx AS section_idx, b.name, b.s AS start_line, b.e AS end_line, p.idx AS parent_index FROM nested b LEFT JOIN nested p ON b.parent = p.s AND p.parent IS NULL""")
def build_sections_q(spark, sf):
    return build_sections(bugreport_lines(spark, sf)).drop("source_id")


@query("parse_bugreport", with_lines(f""", x AS (SELECT line_num, line_num % 97 AS r, line_num // 97 AS j, ts_ns // 1000000 * 1000000 AS t, tag, message FROM lines)
SELECT line_num, CASE WHEN r IN (0, 60, 10, 30, 70) OR line_num = 1 THEN NULL WHEN t > epoch_ns(TIMESTAMP '{CAPTURED}') + 300000000000 THEN t - 365 * 86400000000000 ELSE t END AS ts_ns,
  CASE WHEN r IN (60, 70) THEN 'Verbose' ELSE 'Info' END AS level, CASE WHEN line_num = 1 THEN 'dumpstate'
  WHEN r IN (0, 60) THEN CASE WHEN j % 5 = 0 THEN 'DUMPSYS NORMAL' ELSE 'SEC' || (j % 5) END WHEN r IN (10, 30, 70) THEN '' ELSE tag END AS tag FROM x"""))
def parse_bugreport(spark, sf):
    return parse.parse_bugreport(bugreport_lines(spark, sf), 2024).select("line_num", "ts_ns", "level", "tag")


@query("sections_of_capture", f"""WITH {LINES}, {SECTIONS}
SELECT l.line_num, (SELECT b.name FROM nested b WHERE l.line_num BETWEEN b.s AND b.e ORDER BY b.s DESC LIMIT 1) AS section FROM lines l""")
def sections_of_capture(spark, sf):
    raw = bugreport_lines(spark, sf)
    return with_section(raw, build_sections(raw)).select("line_num", "section")


@query("device_facts", """WITH o AS (SELECT * FROM orders), k AS (SELECT o_custkey, min(o_orderkey) AS first FROM o GROUP BY 1)
SELECT CAST(o_custkey AS VARCHAR) AS source_id, 'build' || first AS build, 'user' AS build_type, CAST(first % 9 AS VARCHAR) AS os_version, 'S' || first AS serial FROM k""")
def device_facts(spark, sf):
    """Customers as captures: each order writes header lines; the first of each kind is the fact."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").cast("string").alias("source_id"), "o_orderkey")
    k = F.col("o_orderkey")
    texts = F.array(F.concat(F.lit("Build: build"), k, F.lit("  (user)")),
                    F.concat(F.lit("Build fingerprint: 'brand/x/dev:"), k % 9, F.lit("/id/1:user/keys'")),
                    F.concat(F.lit("cmdline: androidboot.serialno=S"), k, F.lit(" quiet")))
    lines = o.select("source_id", "o_orderkey", F.posexplode(texts).alias("p", "raw")).withColumn("line_num", k * 3 + F.col("p"))
    none = build_sections(lines)
    facts = parse.device_facts(lines, none)
    return facts.select("source_id", F.regexp_replace("build", r"\s+\(user\)$", "").alias("build"), "build_type", "os_version", "serial")


@query("detect_source_type", with_lines("""
SELECT DISTINCT source_id, CASE source_id WHEN '0' THEN 'Dumpstate' WHEN '1' THEN 'Logcat' WHEN '2' THEN 'Kernel' ELSE 'Radio' END AS source_type FROM lines"""))
def detect_source_type(spark, sf):
    s = F.col("source_id")
    raw = (F.when(s == "0", F.concat(F.lit("== dumpstate: "), clock(F.col("ts_ns")))).when(s == "1", F.concat(clock(F.col("ts_ns")), F.lit(" 1 2 I t: m")))
           .when(s == "2", F.concat(F.lit("[ 12."), F.col("tid"), F.lit("] usb"))).otherwise(F.concat(F.lit("RILJ "), F.col("message"))))
    return text.detect_source_type(raw_lines(spark, sf, raw))


@query("write_and_read_lines", with_lines("SELECT raw, 0 AS misplaced FROM lines"))
def write_and_read_lines(spark, sf):
    """Lines written in order and read again: every text once, numbers contiguous and in the written order in each file."""
    ensure_checkpoint_dir(spark)
    out = f"{spark.sparkContext.getCheckpointDir()}/lines-{uuid.uuid4().hex}"
    text.write_lines(event_lines(spark, sf), out, "text")
    back = text.read_lines(spark, out)
    event = F.regexp_extract("raw", r"^(\d+)", 1).cast("bigint")
    # Inside a file event numbers rise with line numbers, so both give the same sums over equal ranks.
    from pyspark.sql import Window as W
    by_line, by_event = W.partitionBy("source_id").orderBy("line_num"), W.partitionBy("source_id").orderBy(event)
    moved = (F.row_number().over(by_line) != F.row_number().over(by_event)) | (F.row_number().over(by_line) - 1 != F.col("line_num"))
    return back.select("raw", moved.cast("int").alias("misplaced"))
