"""Captures written from the given tables and read back: archives, UTF-16, live text, file keys, annotations, results.

Files hold at most ``PER_FILE`` documents or ``PER_TEXT`` events each, whatever the size of the tables, and are written by tasks.
"""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from linespark.functions.extract import field
from linespark.operators import pii, tracker
from linespark.operators.ordered import ensure_checkpoint_dir
from linespark.sources import text
from linespark.streaming.live import run_available, stream_numbered

from .adapters import event_lines, table, with_lines
from .ordered import BLOCK, DEFAULTS, TRACK, LINES, tracker_rules
from .registry import query

PER_FILE, PER_TEXT = 50, 5000


def shared_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def as_zip(body: bytes) -> bytes:
    """An archive with the text, a smaller text and a larger member that is no text."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("notes.txt", b"")
        z.writestr("capture.TXT", body)
        z.writestr("dump.bin", body + body)
    return out.getvalue()


def write_files(lines: DataFrame, base: str, ending: str, encode) -> None:
    """One file ``<file>.<ending>`` for each value of ``file`` from its rows (file, n, raw) in order of ``n``."""
    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs
        body = "".join(f"{r}\n" for r in pdf.sort_values("n")["raw"])
        if base.startswith("file:"):
            system, folder = fs.LocalFileSystem(), "/" + base.removeprefix("file:").lstrip("/")
        else:
            system, folder = fs.FileSystem.from_uri(base) if "://" in base else (fs.LocalFileSystem(), base)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{pdf['file'].iloc[0]}.{ending}") as out:
            out.write(encode(body))
        return pdf[["file"]].head(1)

    lines.select("file", "n", "raw").groupBy("file").applyInPandas(write, "file long").write.format("noop").mode("overwrite").save()


def file_number():
    return F.regexp_extract("source_id", r"(\d+)\.[a-z0-9]+$", 1).cast("bigint").alias("file")


def document_rows(spark, sf) -> DataFrame:
    """A line for each document: its id and whole text, line ends told as bars."""
    body = F.translate(F.coalesce("text", F.lit("")), "\r\n", "||")
    return table(spark, sf, "documents").select(F.expr(f"doc_id div {PER_FILE}").alias("file"), F.col("doc_id").alias("n"),
                                                F.concat(F.col("doc_id").cast("string"), F.lit(" "), body).alias("raw"))


def event_rows(spark, sf) -> DataFrame:
    return event_lines(spark, sf).select(F.expr(f"line_num div {PER_TEXT}").alias("file"), F.col("line_num").alias("n"), "raw")


DOCUMENT_ROWS = f"""SELECT doc_id // {PER_FILE} AS file, row_number() OVER (PARTITION BY doc_id // {PER_FILE} ORDER BY doc_id) - 1 AS line_num,
  doc_id || ' ' || translate(coalesce(text, ''), chr(13) || chr(10), '||') AS raw FROM documents"""


@query("read_zipped_lines", DOCUMENT_ROWS)
def read_zipped_lines(spark, sf):
    """Documents put into zip archives; the largest text member is read."""
    base = shared_folder(spark)
    write_files(document_rows(spark, sf), base, "zip", as_zip)
    return text.read_zipped_lines(spark, f"{base}/*.zip").select(file_number(), "line_num", "raw")


@query("read_utf16_lines", DOCUMENT_ROWS)
def read_utf16_lines(spark, sf):
    """Documents as UTF-16 texts with a byte order mark."""
    base = shared_folder(spark)
    write_files(document_rows(spark, sf), base, "txt", lambda body: body.encode("utf-16"))
    return text.read_lines(spark, f"{base}/*.txt", encoding="utf-16").select(file_number(), "line_num", "raw")


@query("stream_lines", with_lines(f"""
SELECT line_num // {PER_TEXT} AS file, raw, lag(raw) OVER (PARTITION BY line_num // {PER_TEXT} ORDER BY line_num) AS before FROM lines"""))
def stream_lines(spark, sf):
    """Texts read as a stream; each line with the one before it by ``line_num``."""
    base = shared_folder(spark)
    write_files(event_rows(spark, sf), f"{base}/in", "txt", str.encode)
    got = run_available(text.stream_lines(spark, f"{base}/in"), f"{base}/out", f"{base}/state")
    # A file holds at most PER_TEXT lines, so the window is bounded.
    return got.select(file_number(), "line_num", "raw").withColumn(
        "before", F.lag("raw").over(W.partitionBy("file").orderBy("line_num"))).drop("line_num")


@query("stream_numbered", with_lines(f"""
SELECT line_num // {PER_TEXT} AS file, row_number() OVER (PARTITION BY line_num // {PER_TEXT} ORDER BY line_num) - 1 AS line_num, raw FROM lines"""))
def stream_numbered_q(spark, sf):
    """Texts read as a stream, a few files a batch, with the numbers that a batch reader gives."""
    base = shared_folder(spark)
    write_files(event_rows(spark, sf), f"{base}/in", "txt", str.encode)
    got = text.stream_lines(spark, f"{base}/in", max_files=8)
    stream_numbered(got, f"{base}/out", f"{base}/counts", f"{base}/state", available_now=True).awaitTermination()
    return spark.read.schema("source_id string, line_num long, raw string").parquet(f"{base}/out").select(file_number(), "line_num", "raw")


@query("source_key", with_lines(f"""
SELECT file, size AS length, true AS one_key, count(*) OVER () AS files FROM (
  SELECT line_num // {PER_TEXT} AS file, sum(strlen(raw) + 1)::BIGINT AS size FROM lines GROUP BY 1)"""))
def source_key(spark, sf):
    """Length of each text; that its key comes again, is a SHA-256 text, and no two texts share one (``files``)."""
    base = shared_folder(spark)
    write_files(event_rows(spark, sf), base, "txt", str.encode)
    first, again = text.source_key(spark, f"{base}/*.txt"), text.source_key(spark, f"{base}/*.txt").select("source_id", F.col("source_key").alias("k"))
    distinct = first.agg(F.count_distinct("source_key").alias("files"))
    return first.join(again, "source_id").join(F.broadcast(distinct), F.lit(True)).select(
        file_number(), "length", ((F.col("source_key") == F.col("k")) & (F.length("k") == 64)).alias("one_key"), "files")


@query("read_annotations", with_lines("""
SELECT source_id, 'b' || line_num AS annotation_id, 'mark' AS label, 'k=' || k AS note, line_num AS start_line, CASE WHEN k % 2 = 0 THEN line_num + 3 END AS end_line
  FROM lines WHERE tag = 'error'
UNION ALL SELECT source_id, 'a' || line_num, 'ref' || i, 'part ' || tag, line_num + i, line_num + 2 * i FROM lines, range(3) r(i) WHERE tag = 'purchase' AND i >= k % 3"""))
def read_annotations(spark, sf):
    """Errors as bookmarks and purchases as analyses with up to three references, through JSON lines."""
    base, x = shared_folder(spark), event_lines(spark, sf)
    n, k = F.col("line_num"), F.col("tid")
    x.filter("tag = 'error'").select(
        "source_id", F.concat(F.lit("b"), n).alias("id"), F.lit("mark").alias("label"), F.concat(F.lit("k="), k).alias("note"), n.alias("line"),
        F.when(k % 2 == 0, n + 3).alias("line_end")).write.json(base)
    refs = F.transform(F.sequence(k % 3, F.lit(2)), lambda i: F.struct((n + i).alias("line"), (n + 2 * i).alias("end_line"),
                                                                      F.concat(F.lit("ref"), i).alias("label")))
    section = F.struct(F.concat(F.lit("part "), "tag").alias("heading"), F.col("message").alias("body"), refs.alias("references"))
    x.filter("tag = 'purchase'").select("source_id", F.concat(F.lit("a"), n).alias("id"), F.array(section).alias("sections")).write.mode("append").json(base)
    return text.read_annotations(spark, base)


@query("write_result", with_lines("""
SELECT source_id, line_num::VARCHAR AS line_num, '{"tag":"' || tag || '","cents":"' || cents || '"}' AS fields,
  '{"tag":"' || tag || '","k":' || k || '}' AS pair FROM lines"""))
def write_result(spark, sf):
    """Maps and structs as JSON text in CSV."""
    base, cents = shared_folder(spark), field(r"cents=(\d+)")
    out = event_lines(spark, sf).select("source_id", "line_num", F.create_map(F.lit("tag"), "tag", F.lit("cents"), cents).alias("fields"),
                                        F.struct("tag", F.col("tid").alias("k")).alias("pair"))
    text.write_result(out, base, "csv")
    return spark.read.option("header", True).option("escape", '"').schema("source_id string, line_num string, fields string, pair string").csv(base)


# A value of each category with the label before it; '#' stands for the user number as four digits.
PLANTED = {
    "EMAIL": ("", "person#@mail.example.com"), "IPv4": ("", "10.20.30.4"), "IPv6": ("", "2001:db8:0:1:2:3:4:5"), "MAC": ("", "a0:b1:c2:d3:e4:0f"),
    "IMEI": ("", "35693803564#"), "SERIAL": ("serial=", "R52ABC#"), "AID": ("", "a1b2c3d4e5f6#"), "TOKEN": ("", "Bearer abcdefghijklmnopqrstuvwxyz012345#"),
    "JWT": ("", "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeK#"), "KEY": ("", "AKIAIOSFODNN7EXA#"), "GAID": ("gaid: ", "38400000-8cf0-11bd-b23e-10b96e40#"),
    "SESSION": ("session_id=", "abcdefghij0123456789#"), "CRED": ("", "https://name#:secret@host.example.com"), "PHONE": ("", "+1 (555) 010-9999"),
}


def _planted(user: str) -> list[tuple[str, str, str]]:
    """Category, label and value as SQL text."""
    return [(c, label, "'" + value.replace("#", f"' || {user} || '") + "'") for c, (label, value) in PLANTED.items()]


USER4 = "lpad(CAST({n} AS {t}), 4, '0')"


@query("pii_offsets", with_lines(", p AS (" + " UNION ALL ".join(
    f"SELECT source_id, line_num, '{c}' AS category, strlen('at {label}') AS start, {v} AS raw FROM lines WHERE line_num % {len(PLANTED)} = {i}"
    for i, (c, label, v) in enumerate(_planted(USER4.format(n="pid", t="VARCHAR")))) + """)
SELECT source_id, line_num, category, start, start + strlen(raw) AS "end", raw FROM p"""))
def pii_offsets(spark, sf):
    """A value of every category in turn, with its place in the text; wider values win over those inside them."""
    message = None
    for i, (_, label, v) in enumerate(_planted(USER4.format(n="pid", t="STRING"))):
        body, cond = F.expr(f"'at {label}' || {v} || ' end'"), F.col("line_num") % len(PLANTED) == i
        message = F.when(cond, body) if message is None else message.when(cond, body)
    return pii.detect_pii(event_lines(spark, sf).withColumn("message", message), categories=tuple(pii.DETECTORS))


@query("track_then_mask", f"""WITH {LINES}, {TRACK},
v AS (SELECT CAST(pid AS VARCHAR) AS raw, min({{'s': source_id, 'l': line_num}}) AS place FROM lines GROUP BY 1),
k AS (SELECT raw, '<PII-' || row_number() OVER (ORDER BY place) || '>' AS token FROM v)
SELECT source_id, line_num, field, coalesce(f.token, from_value) AS from_value, coalesce(t.token, to_value) AS to_value
FROM tr LEFT JOIN k f ON field = 'who' AND f.raw = from_value LEFT JOIN k t ON field = 'who' AND t.raw = to_value""")
def track_then_mask(spark, sf):
    """State tracked on the plain text, values masked afterwards by the tokens of the masked lines."""
    x = event_lines(spark, sf)
    _, tokens = pii.mask_lines(x.select("source_id", "line_num", "message"), categories=(), custom={"PII": r"(?<=user=)\d+"})
    tracked = tracker.track_state(x, tracker_rules(), DEFAULTS, "shop", block_lines=BLOCK)
    return tracker.flat_changes(tracker.mask_transitions(tracked, tokens)).select("source_id", "line_num", "field", "from_value", "to_value")
