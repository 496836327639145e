"""Reading text captures as ordered lines, and writing results."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..schemas import ANNOTATION

UTF16 = {"utf-16", "utf-16le", "utf-16be"}


def source_of(path: Column) -> Column:
    """Default source id: the file's path, which is unique."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_lines(spark: SparkSession, paths: str | list[str], encoding: str | None = None) -> DataFrame:
    """``source_id, line_num, raw`` of text files; line numbers are contiguous from 0 per file.

    UTF-8 files are split among tasks. A split's rows stay in file order in one task, so a line's number is
    the line count of the earlier splits plus its place in its own split: lines are not shuffled, only
    one count per split is. UTF-16 files cannot be split by bytes and are read whole, one file per row.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if encoding and encoding.lower().replace("_", "-") in UTF16:
        return _read_utf16(spark, paths, encoding.upper().replace("_", "-"))
    rows = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"), F.col("value"))
    counts = rows.groupBy("_path", "_split").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = W.partitionBy("_path").orderBy("_split").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    num = F.col("_base") + F.col("_at") - F.col("_first")
    raw = F.regexp_replace("value", "\r$", "")
    raw = F.when((num == 0) & raw.startswith("﻿"), F.substr(raw, F.lit(2))).otherwise(raw)
    return rows.join(starts, ["_path", "_split"]).select(
        source_of(F.col("_path")).alias("source_id"), num.alias("line_num"), raw.alias("raw"))


def _split_lines(df: DataFrame, text: Column) -> DataFrame:
    """Explode whole texts into lines; the empty piece after a final newline is no line."""
    body = F.regexp_replace(text, "^﻿", "")
    body = F.regexp_replace(body, "\r?\n\\z", "\n")
    pieces = F.split(F.regexp_replace(body, "\n\\z", ""), "\r?\n", -1)
    pieces = F.when(body == "", F.array().cast("array<string>")).otherwise(pieces)
    return df.select("source_id", F.posexplode(pieces).alias("_n", "raw")).select(
        "source_id", F.col("_n").cast("bigint").alias("line_num"), F.regexp_replace("raw", "\r$", "").alias("raw"))


def _read_utf16(spark: SparkSession, paths: list[str], charset: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths)
    bom = F.hex(F.substring("content", 1, 2))
    little = F.decode("content", "UTF-16LE")
    big = F.decode("content", "UTF-16BE")
    default = big if charset == "UTF-16BE" else little
    text = F.when(bom == "FFFE", little).when(bom == "FEFF", big).otherwise(default)
    return _split_lines(files.select(source_of(F.col("path")).alias("source_id"), text.alias("_text")), F.col("_text"))


def read_zipped_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of the largest ``.txt`` member of each zip archive (one task per archive)."""
    files = spark.read.format("binaryFile").load(paths).select(
        source_of(F.col("path")).alias("source_id"), "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile
        for pdf in batches:
            rows = []
            for sid, data in zip(pdf["source_id"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    texts = [i for i in z.infolist() if i.filename.lower().endswith(".txt")]
                    if texts:
                        best = max(texts, key=lambda i: i.file_size)
                        rows.append((sid, z.read(best).decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["source_id", "_text"])

    return _split_lines(files.mapInPandas(unpack, "source_id string, _text string"), F.col("_text"))


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """``source_id, line_num, raw`` as an append-only stream from a folder; parse it like a batch.

    ``line_num`` is a place in the file in bytes: unique and rising inside a file, with gaps. Counting lines needs
    the splits before, which a row of a stream does not know; ``streaming.live.stream_numbered`` counts them batch by batch.
    """
    reader = spark.readStream.option("lineSep", "\n")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_split"), "value")
    raw = F.regexp_replace("value", "\r$", "")
    raw = F.when((F.col("line_num") == 0) & raw.startswith("﻿"), F.substr(raw, F.lit(2))).otherwise(raw)
    return rows.mapInArrow(_place_in_file, "_path string, line_num bigint, value string").select(
        source_of(F.col("_path")).alias("source_id"), "line_num", raw.alias("raw"))


def _place_in_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of a split's earlier lines after the split's start.

    A later split leaves out the rest of a line it starts in, so its places are too small by at least one byte; one is
    added so that they stay above those of the split before.
    """
    split, used = None, 0
    for b in batches:
        places = []
        for path, start, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), pc.binary_length(b.column(2)).to_pylist()):
            if (path, start) != split:
                split, used = (path, start), start + (start > 0)
            places.append(used)
            used += size + 1
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(places, pa.int64()), b.column(2)], ["_path", "line_num", "value"])


def source_key(spark: SparkSession, paths: str | list[str], prefix_bytes: int = 4096) -> DataFrame:
    """Stable key of each file: hash over path, length and leading bytes."""
    files = spark.read.format("binaryFile").load(paths)
    head = F.hex(F.substring("content", 1, prefix_bytes))
    return files.select(source_of(F.col("path")).alias("source_id"), F.col("length"),
                        F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), head), 256).alias("source_key"))


def detect_source_type(lines: DataFrame, sample_chars: int = 4096) -> DataFrame:
    """Kind of each source from its first 4 KiB: dumpstate, bugreport, logcat, kernel, radio, else logcat.

    Only the leading lines are looked at: at most ``sample_chars`` of them can matter, as every line takes at
    least one character with its line end.
    """
    head = lines.filter(F.col("line_num") < sample_chars).select("source_id", "line_num", "raw")
    w = W.partitionBy("source_id").orderBy("line_num").rowsBetween(W.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.octet_length("raw") + 1).over(w), F.lit(0))
    head = head.withColumn("_used", used).filter(F.col("_used") < sample_chars).withColumn(
        "raw", F.substring("raw", F.lit(1), F.lit(sample_chars) - F.col("_used")))
    r = F.col("raw")
    early = F.col("line_num") < 10
    seen = lambda *words: F.bool_or(F.lit(False) if not words else _any_of(r, words))
    kernel_shape = early & F.trim(r).rlike(r"^\[[0-9 ]*\.[0-9. ]*\]")
    threadtime_shape = early & ~r.startswith("-----") & r.rlike(r"^..-.. ..:..:..\..")
    flags = head.groupBy("source_id").agg(
        seen("== dumpstate:").alias("d"), seen("Bugreport format version:").alias("b"),
        F.bool_or(r.contains("--------- beginning of") | threadtime_shape).alias("l"),
        F.bool_or(r.contains("[    0.") | r.contains("Linux version") | kernel_shape).alias("k"),
        seen("RIL").alias("r"))
    kind = (F.when(F.col("d"), "Dumpstate").when(F.col("b"), "Bugreport").when(F.col("l"), "Logcat")
            .when(F.col("k"), "Kernel").when(F.col("r"), "Radio").otherwise("Logcat"))
    return flags.select("source_id", kind.alias("source_type"))


def _any_of(c: Column, words) -> Column:
    out = c.contains(words[0])
    for w in words[1:]:
        out = out | c.contains(w)
    return out


def write_lines(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", column: str = "raw") -> None:
    """Lines in order inside each file, one folder per source; text keeps only ``column``."""
    out = df.repartitionByRange("source_id", "line_num").sortWithinPartitions("source_id", "line_num")
    if fmt == "text":
        out = out.select("source_id", F.col(column).alias("value"))
    out.write.mode(mode).partitionBy("source_id").format(fmt).save(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Emissions, transitions, correlations, charts or a PII map; maps and structs become JSON text in CSV, quotes doubled."""
    if fmt == "csv":
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("map", "struct", "array")]
        df = df.withColumns({n: F.to_json(n) for n in nested})
        df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode(mode).format(fmt).save(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Bookmarks and analysis references from JSON lines, as line intervals.

    A bookmark is ``{source_id, id, label, note, line, line_end}``; an analysis has
    ``{source_id, id, sections: [{heading, body, references: [{line, end_line, label}]}]}``.
    """
    schema = ("source_id string, id string, label string, note string, line long, line_end long, "
              "sections array<struct<heading:string,body:string,references:array<struct<line:long,end_line:long,label:string>>>>")
    raw = spark.read.schema(schema).json(path)
    marks = raw.filter("sections IS NULL AND line IS NOT NULL").select(
        "source_id", F.col("id").alias("annotation_id"), "label", "note", F.col("line").alias("start_line"),
        F.col("line_end").alias("end_line"))
    refs = raw.filter("sections IS NOT NULL").select("source_id", "id", F.explode("sections").alias("s")).select(
        "source_id", "id", "s.heading", F.explode("s.references").alias("r")).select(
        "source_id", F.col("id").alias("annotation_id"), F.col("r.label").alias("label"),
        F.col("heading").alias("note"), F.col("r.line").alias("start_line"), F.col("r.end_line").alias("end_line"))
    return marks.unionByName(refs).select(*ANNOTATION.fieldNames())
