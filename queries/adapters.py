"""The given tables as log lines, in Spark and in the same words in SQL.

``events`` become lines of four sources (user id modulo 4) numbered by event id; a document is a source of text
lines; a conversation is a source whose turns are lines and whose user turns open sections. Amounts appear in texts as
whole cents so that both engines print them alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from linespark.functions.levels import level_name
from linespark.schemas import LINE_COLUMNS

LEVEL_OF = {"view": 0, "click": 1, "signup": 2, "purchase": 3, "error": 4}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _ntz_ns(ts: Column) -> Column:
    """Wall-clock time to ns without regard to the session time zone."""
    days = F.unix_date(ts.cast("date")).cast("bigint")
    secs = (days * 24 + F.hour(ts)) * 3600 + F.minute(ts) * 60
    micros = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return (secs * 1_000_000 + micros) * 1000


def with_event_parts(ev: DataFrame) -> DataFrame:
    return ev.withColumns({
        "ts_ns": _ntz_ns(F.col("ts")), "k": F.regexp_extract("props", r'"k":\s*(-?\d+)', 1).cast("int"),
        "cents": F.round(F.col("value") * 100).cast("bigint"),
        "source_id": (F.col("user_id") % 4).cast("string"), "line_num": F.col("event_id")})


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with ``source_id, line_num, ts_ns, k, cents`` added."""
    return with_event_parts(table(spark, sf, "events"))


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines_of(events(spark, sf))


def lines_of(e: DataFrame) -> DataFrame:
    rank = None
    for name, r in LEVEL_OF.items():
        cond = F.col("event_type") == name
        rank = F.when(cond, F.lit(r)) if rank is None else rank.when(cond, F.lit(r))
    e = e.withColumn("level_ord", rank.cast("tinyint"))
    msg = F.concat_ws(" ", "event_type", F.concat(F.lit("user="), "user_id"), F.concat(F.lit("cents="), "cents"), F.concat(F.lit("k="), "k"))
    return e.select(
        "source_id", F.lit("Logcat").alias("source_type"), "line_num", "ts_ns", level_name("level_ord").alias("level"), "level_ord",
        F.col("event_type").alias("tag"), F.col("user_id").cast("int").alias("pid"), F.col("k").alias("tid"), msg.alias("message"),
        F.concat_ws(" ", "event_id", msg).alias("raw"))


EVENTS = """e AS (
  SELECT *, epoch_us(ts) * 1000 AS ts_ns, CAST(regexp_extract(props, '"k":\\s*(-?\\d+)', 1) AS INTEGER) AS k,
         CAST(round(value * 100) AS BIGINT) AS cents, CAST(user_id % 4 AS VARCHAR) AS source_id, event_id AS line_num
  FROM events)"""
LINES = EVENTS + """, lines AS (
  SELECT source_id, 'Logcat' AS source_type, line_num, ts_ns,
         CASE event_type WHEN 'view' THEN 'Verbose' WHEN 'click' THEN 'Debug' WHEN 'signup' THEN 'Info'
              WHEN 'purchase' THEN 'Warn' WHEN 'error' THEN 'Error' END AS level,
         CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3
              WHEN 'error' THEN 4 END AS level_ord,
         event_type AS tag, user_id AS pid, k AS tid, cents, k,
         event_type || ' user=' || user_id || ' cents=' || cents || ' k=' || k AS message,
         event_id || ' ' || event_type || ' user=' || user_id || ' cents=' || cents || ' k=' || k AS raw
  FROM e)"""


def with_lines(body: str) -> str:
    """The line tables, then a query or, after a comma, more tables and a query."""
    return f"WITH {LINES}{body}" if body.lstrip().startswith(",") else f"WITH {LINES}\n{body}"


def with_events(body: str) -> str:
    return f"WITH {EVENTS}{body}" if body.lstrip().startswith(",") else f"WITH {EVENTS}\n{body}"


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One row per text line of each document."""
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("source_id"), F.col("lang").alias("tag"),
                    F.posexplode(F.split("text", "\n", -1)).alias("_n", "message")).select(
        "source_id", F.col("_n").cast("bigint").alias("line_num"), "tag", "message", F.col("message").alias("raw"))


DOC_LINES = """d AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, lang AS tag, string_split(text, chr(10)) AS parts FROM documents),
doc_lines AS (SELECT source_id, tag, CAST(n AS BIGINT) AS line_num, parts[n + 1] AS message
  FROM (SELECT source_id, tag, parts, unnest(range(len(parts))) AS n FROM d))"""


def turn_lines(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("source_id"), F.col("turn").alias("line_num"), F.col("role").alias("tag"),
                    F.col("text").alias("message"), F.col("text").alias("raw"))


def turn_sections(spark: SparkSession, sf: str) -> DataFrame:
    """A section from every user turn to the turn after it; ``parent_index`` of odd sections is the one before."""
    users = turn_lines(spark, sf).filter("tag = 'user'")
    n = F.row_number().over(W.partitionBy("source_id").orderBy("line_num")) - 1
    return users.withColumn("section_idx", n.cast("int")).select(
        "source_id", "section_idx", F.concat(F.lit("SECTION "), F.col("section_idx") % 3).alias("name"),
        F.col("line_num").alias("start_line"), (F.col("line_num") + 1).alias("end_line"),
        F.when(F.col("section_idx") % 2 == 1, F.col("section_idx") - 1).cast("int").alias("parent_index"))


TURNS = """t AS (SELECT CAST(conv_id AS VARCHAR) AS source_id, turn AS line_num, role AS tag, text AS message, text AS raw
  FROM conversations),
s0 AS (SELECT source_id, line_num, row_number() OVER (PARTITION BY source_id ORDER BY line_num) - 1 AS i FROM t WHERE tag = 'user'),
sections AS (SELECT source_id, i AS section_idx, 'SECTION ' || (i % 3) AS name, line_num AS start_line, line_num + 1 AS end_line,
  CASE WHEN i % 2 = 1 THEN i - 1 END AS parent_index FROM s0)"""


def event_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of the event sources: every 97th line opens one of 60 lines named after its event type."""
    starts = event_lines(spark, sf).filter(F.col("line_num") % 97 == 0)
    n = F.row_number().over(W.partitionBy("source_id").orderBy("line_num")) - 1
    return starts.select("source_id", n.cast("int").alias("section_idx"), F.col("tag").alias("name"),
                         F.col("line_num").alias("start_line"), (F.col("line_num") + 59).alias("end_line"),
                         F.lit(None).cast("int").alias("parent_index"))


EVENT_SECTIONS = """sections AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY line_num) - 1 AS section_idx,
  tag AS name, line_num AS start_line, line_num + 59 AS end_line FROM lines WHERE line_num % 97 = 0)"""
