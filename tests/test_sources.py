"""Reading, parsing and section building on hand-written texts."""

from __future__ import annotations

import csv
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from linespark.operators.sections import build_sections, in_sections, section_groups
from linespark.sources import parse, text
from tests import folds

NS = 10**9


def raw(spark, lines, source="s"):
    return spark.createDataFrame([(source, i, t) for i, t in enumerate(lines)], "source_id string, line_num long, raw string")


def back(df):
    return [r.raw for r in df.orderBy("source_id", "line_num").collect()]


@pytest.mark.parametrize("body,want", [
    (b"a\nb\n", ["a", "b"]), (b"a\r\n\r\nb", ["a", "", "b"]), (b"\xef\xbb\xbfa\n\n", ["a", ""]), (b"", []), (b"x\ry\nz", ["x\ry", "z"])])
def test_read_lines(spark, tmp_path, body, want):
    (tmp_path / "f.txt").write_bytes(body)
    got = text.read_lines(spark, str(tmp_path / "f.txt"))
    assert back(got) == want
    assert [r.line_num for r in got.orderBy("line_num").collect()] == list(range(len(want)))


@pytest.mark.parametrize("charset,bom", [("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff")])
def test_read_utf16(spark, tmp_path, charset, bom):
    (tmp_path / "f.txt").write_bytes(bom + "één\r\n\r\nzwei\n".encode(charset))
    assert back(text.read_lines(spark, str(tmp_path / "f.txt"), encoding="utf-16")) == ["één", "", "zwei"]


def test_numbers_are_contiguous_over_splits(spark, tmp_path):
    for name, n in (("a.txt", 5000), ("b.txt", 3)):
        (tmp_path / name).write_text("".join(f"{i:09d}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = text.read_lines(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
        assert got.rdd.getNumPartitions() > 5
        assert got.filter(F.col("raw").cast("bigint") != F.col("line_num")).count() == 0 and got.count() == 5003
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("small.txt", "no\n")
        z.writestr("big.txt", "one\ntwo\nthree\n")
        z.writestr("huge.bin", "x" * 1000)
    assert back(text.read_zipped_lines(spark, str(tmp_path / "c.zip"))) == ["one", "two", "three"]


def test_write_and_source_key(spark, tmp_path):
    df = folds.lines(spark, [("a", i, i, "", f"m{i}") for i in range(20)])
    text.write_lines(df, str(tmp_path / "out"), "text")
    assert back(text.read_lines(spark, str(tmp_path / "out"))) == [f"m{i}" for i in range(20)]
    text.write_result(df.select("source_id", F.create_map(F.lit("k"), "message").alias("m")), str(tmp_path / "csv"), "csv")
    told = [json.loads(r["m"])["k"] for part in (tmp_path / "csv").glob("*.csv") for r in csv.DictReader(part.read_text().splitlines())]
    assert sorted(told) == sorted(f"m{i}" for i in range(20))
    (tmp_path / "k.txt").write_text("hello")
    keys = {text.source_key(spark, str(tmp_path / "k.txt")).first().source_key for _ in range(2)}
    assert len(keys) == 1 and len(keys.pop()) == 64


def test_annotations(spark, tmp_path):
    rows = [{"source_id": "s", "id": "b1", "label": "mark", "line": 5},
            {"source_id": "s", "id": "a1", "sections": [{"heading": "H", "body": "x", "references": [{"line": 1, "end_line": 3, "label": "r"}]}]}]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    got = text.read_annotations(spark, str(tmp_path / "a.json")).orderBy("start_line").collect()
    assert [(r.annotation_id, r.label, r.note, r.start_line, r.end_line) for r in got] == [("a1", "r", "H", 1, 3), ("b1", "mark", None, 5, None)]


def test_logcat(spark):
    lines = ["01-02 03:04:05.678  1000  2000 W Tag : hello: world", "01-02 03:04:05.678 10123  1000  2000 E A B: x", "01-02 03:04:05.678 wifi  1000  2000 I T:",
             "--------- beginning of main", "D/Brief( 77): text", "free text", "", "13-40 03:04:05.678  1  2 I T: bad date"]
    got = parse.parse_logcat(raw(spark, lines), 2024).orderBy("line_num").collect()
    assert [(r.line_num, r.level, r.tag, r.pid, r.tid, r.message) for r in got] == [
        (0, "Warn", "Tag", 1000, 2000, "hello: world"), (1, "Error", "A B", 1000, 2000, "x"), (2, "Info", "T", 1000, 2000, ""),
        (4, "Debug", "Brief", 77, 0, "text"), (5, "Info", "", 0, 0, "free text"), (6, "Info", "", 0, 0, ""), (7, "Info", "T", 1, 2, "bad date")]
    assert got[0].ts_ns == 1704164645 * NS + 678_000_000 and got[3].ts_ns is None and got[6].ts_ns is None
    assert parse.parse_logcat(raw(spark, lines), 2024, keep_separators=True).count() == 8


def test_kernel(spark):
    lines = ["[12345.678901] msg", "<3>[0.000001] (fn) hi", "<12>[    1.5]  x", "not kernel"]
    got = parse.parse_kernel(raw(spark, lines)).orderBy("line_num").collect()
    assert [(r.ts_ns, r.level, r.tag, r.message) for r in got] == [
        (12345678901000, "Info", "kernel", "msg"), (1000, "Error", "fn", "hi"), (1_500_000_000, "Warn", "kernel", "x")]


CAPTURE = ["========", "== dumpstate: 2023-01-05 10:00:00", "========", "Build: UP1A (userdebug)", "Build fingerprint: 'a/b/c:14/UP1A/1:user/keys'",
           "Bootloader: BL1", "x androidboot.serialno = \"R52X\"", "Uptime: up 1 day", "------ KERNEL VERSION (uname) ------", "Linux 5.10", "other",
           "------ 0.001s was the duration of 'KERNEL VERSION' ------", "------ SYSTEM LOG (logcat) ------", "12-31 23:00:00.000  1  2 I T: last year",
           "01-05 10:04:00.000  1  2 I T: in grace", "01-05 10:06:00.000  1  2 I T: too late", "------ 1.0s was the duration of 'SYSTEM LOG' ------",
           "------ DUMPSYS NORMAL (dumpsys) ------", "DUMP OF SERVICE CRITICAL activity:", "a", "DUMP OF SERVICE wifi:", "b",
           "------ 2.0s was the duration of 'DUMPSYS NORMAL' ------", "------ OPEN ENDED ------", "------ SYSTEM PROPERTIES (getprop) ------",
           "[ro.build.version.sdk]: [34]", "[ro.product.model]: [SM-1]", "[ro.product.manufacturer]: [acme]",
           "------ 0.1s was the duration of 'SYSTEM PROPERTIES' ------", "------ 0.1s was the duration of 'NEVER OPENED' ------"]


def test_bugreport(spark):
    got = parse.parse_bugreport(raw(spark, CAPTURE), 2026)
    by = {r.line_num: r for r in got.collect()}
    when = lambda s: int(spark.sql(f"SELECT unix_seconds(timestamp '{s} UTC')").first()[0]) * NS
    assert by[13].ts_ns == when("2022-12-31 23:00:00") and by[14].ts_ns == when("2023-01-05 10:04:00") and by[15].ts_ns == when("2022-01-05 10:06:00")
    assert (by[1].tag, by[8].tag, by[8].level, by[11].tag, by[11].level, by[0].level) == ("dumpstate", "KERNEL VERSION", "Info", "KERNEL VERSION", "Verbose", "Verbose")
    secs = build_sections(got)
    rows = [(r.name, r.start_line, r.end_line, r.parent_index) for r in secs.orderBy("section_idx").collect()]
    assert rows == [("KERNEL VERSION", 8, 11, None), ("SYSTEM LOG", 12, 16, None), ("DUMPSYS NORMAL", 17, 22, None), ("activity", 18, 19, 2),
                    ("wifi", 20, 22, 2), ("SYSTEM PROPERTIES", 24, 28, None)]
    f = parse.device_facts(got, secs).first()
    assert (f.build, f.build_type, f.fingerprint, f.os_version, f.bootloader, f.serial, f.uptime, f.kernel_version, f.sdk, f.model, f.manufacturer) == (
        "UP1A (userdebug)", "userdebug", "a/b/c:14/UP1A/1:user/keys", "14", "BL1", "R52X", "up 1 day", "Linux 5.10", "34", "SM-1", "acme")
    assert {r.line_num for r in in_sections(got, secs, ["SYSTEM LOG", "wifi"]).collect()} == set(range(12, 17)) | {20, 21, 22}
    assert in_sections(got, secs, ["NOPE"]).count() == len(CAPTURE) and in_sections(got, secs, ["NOPE"], "none").count() == 0


def test_nested_same_name_sections(spark):
    foot = "------ 0.1s was the duration of 'A' ------"
    lines = [foot, "------ A ------", "------ A ------", foot, "x", foot, foot, "------ A ------", foot]
    got = [(r.start_line, r.end_line) for r in build_sections(raw(spark, lines)).orderBy("start_line").collect()]
    assert got == [(1, 5), (2, 3), (7, 8)]


def test_detect(spark):
    kinds = {"d": ["x", "== dumpstate: 1"], "b": ["Bugreport format version: 2"], "l": ["01-02 03:04:05.678 1 2 I T: x"], "k": ["[   12.5] usb"],
             "r": ["RILJ x"], "z": ["what"], "late": ["y" * 5000, "== dumpstate: 1"]}
    df = None
    for s, t in kinds.items():
        df = raw(spark, t, s) if df is None else df.unionByName(raw(spark, t, s))
    got = {r.source_id: r.source_type for r in text.detect_source_type(df).collect()}
    assert got == {"d": "Dumpstate", "b": "Bugreport", "l": "Logcat", "k": "Kernel", "r": "Radio", "z": "Logcat", "late": "Logcat"}


def test_section_groups(spark):
    names = [f"SHOW MAP {i}: x" for i in range(5)] + ["ROUTE TABLE a"] + [f"SHOW MAP {i}" for i in range(4)]
    secs = spark.createDataFrame([("s", i, n, i * 10, i * 10 + 4, None) for i, n in enumerate(names)],
                                 "source_id string, section_idx int, name string, start_line long, end_line long, parent_index int")
    assert [(r.prefix, r.sections, r.total_lines) for r in section_groups(secs).collect()] == [("SHOW MAP ", 5, 25)]
