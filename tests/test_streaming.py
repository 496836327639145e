"""Streams fed in several micro-batches give what one batch gives."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from linespark.operators import stateful as batch
from linespark.operators import tracker
from linespark.operators.correlate import correlation_matches
from linespark.sources.parse import parse_logcat
from linespark.sources.text import read_lines, stream_lines
from linespark.streaming import live, stateful
from linespark.streaming.fenced import Fenced, FencedSink, read_committed
from linespark.streaming.live import run_available
from tests import folds
from tests.test_ordered import random_lines, spark_rules, spark_sources


@pytest.fixture
def fed(spark, tmp_path):
    """A stream of three files, one per micro-batch, and the same rows as a batch."""
    rows = random_lines(11, 150)
    lines = folds.lines(spark, rows)
    for i in range(3):
        part = folds.lines(spark, rows[i * 50:(i + 1) * 50])
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = (spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
              .parquet(str(tmp_path / "in")))
    return stream, lines, str(tmp_path / "out"), str(tmp_path / "state")


def test_burst_over_batches(fed):
    stream, lines, out, state = fed
    got = live.run_available(stateful.stream_burst(stream, "tag", 60, 3), out, state).collect()
    want = batch.burst_detect(lines, "tag", 60, 3, line="current").collect()
    key = lambda r: (r.source_id, r.burst_key, r.line_num, r.ts_ns)
    assert sorted(map(key, got)) == sorted(map(key, want)) and want


def test_track_over_batches(fed):
    stream, lines, out, state = fed
    defaults = {"a": None, "b": "", "c": False}
    got = tracker.flat_changes(live.run_available(stateful.stream_track(stream, spark_rules(), defaults), out, state)).collect()
    want = tracker.flat_changes(tracker.track_state(lines, spark_rules(), defaults)).collect()
    key = lambda r: (r.source_id, r.line_num, r.transition, r.field, str(r.from_value), str(r.to_value))
    assert sorted(map(key, got)) == sorted(map(key, want)) and want


@pytest.mark.parametrize("causes", [["c"], ["c", "d"]])
def test_correlate_over_batches(fed, causes):
    stream, lines, out, state = fed
    src = spark_sources()
    args = (src["t"], [src[c] for c in causes], 40, 400)
    got = live.run_available(stateful.stream_correlate(stream, *args), out, state).collect()
    want = correlation_matches(lines, *args).groupBy("source_id", "trigger_line").count().collect()
    assert sorted((r.source_id, r.trigger_line, r.matches) for r in got) == sorted((r.source_id, r.trigger_line, r["count"]) for r in want) and want


def test_masking_keeps_tokens(spark, fed):
    stream, lines, out, state = fed
    live.stream_mask(stream, state + "-map", out, state, available_now=True, categories=(), custom={"PII": r"m\d"}).awaitTermination()
    masked = spark.read.parquet(out).select("source_id", "line_num", "message").join(
        lines.select("source_id", "line_num", F.col("message").alias("plain")), ["source_id", "line_num"])
    assert masked.count() == lines.count()
    assert masked.select("message", "plain").distinct().count() == lines.select("message").distinct().count()


def test_watch_totals(fed):
    stream, lines, out, state = fed
    got = {r.watch: r.total for r in live.run_totals(live.stream_watch(stream, {"x": F.col("tag") == "x", "m1": F.col("message") == "m1"}), out, state).collect()}
    assert got == {"x": lines.filter("tag = 'x'").count(), "m1": lines.filter("message = 'm1'").count()}


def test_rule_name_changes_with_rules():
    assert live.rule_name("q", ("a",)) != live.rule_name("q", ("b",)) and live.rule_name("q", ("a",)) == live.rule_name("q", ("a",))


def test_streamed_text_lines_parse_in_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [f"03-01 10:00:{i % 60:02d}.{i // 60:03d}  100  200 I Tag: message {i}" for i in range(500)]
    (tmp_path / "in" / "a.txt").write_text("\ufeff" + "\r\n".join(lines) + "\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        parsed = parse_logcat(stream_lines(spark, str(tmp_path / "in")), capture_year=2024)
        rows = run_available(parsed, str(tmp_path / "out"), str(tmp_path / "state")).orderBy("line_num").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["message"] for r in rows] == [f"message {i}" for i in range(500)]
    assert rows[0]["line_num"] == 0 and len({r["line_num"] for r in rows}) == 500


def test_streamed_lines_are_numbered_as_in_a_batch(spark, tmp_path):
    """Files of a folder arrive one by one: as sources of their own, and as one source; a batch done again changes nothing."""
    import os
    bodies = {"a.txt": "\ufeff" + "".join(f"a{i}\r\n" for i in range(700)), "b.txt": "", "c.txt": "\n\nc", "d.txt": "".join(f"d {i}\n" for i in range(40))}
    (tmp_path / "dev").mkdir()
    for n, (name, body) in enumerate(bodies.items()):
        (tmp_path / "dev" / name).write_bytes(body.encode())
        os.utime(tmp_path / "dev" / name, (1_700_000_000 + n, 1_700_000_000 + n))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    shape = "source_id string, line_num long, raw string"
    try:
        want = {tuple(r) for r in read_lines(spark, str(tmp_path / "dev")).collect()}
        got = {}
        for kind, owner in (("file", None), ("folder", F.regexp_replace("source_id", "/[^/]*$", ""))):
            at = tmp_path / kind
            live.stream_numbered(stream_lines(spark, str(tmp_path / "dev"), max_files=1), str(at / "out"), str(at / "counts"), str(at / "state"), owner, True,
                                 block_bytes=256).awaitTermination()
            got[kind] = spark.read.schema(shape).parquet(str(at / "out")).drop("batch").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {tuple(r) for r in got["file"]} == want and len(got["file"]) == len(want) == 743
    whole = [line for body in bodies.values() for line in body.lstrip("\ufeff").replace("\r\n", "\n").splitlines()]
    assert [(r.line_num, r.raw) for r in sorted(got["folder"], key=lambda r: r.line_num)] == list(enumerate(whole))
    again = spark.createDataFrame([(str(tmp_path / "dev" / "d.txt"), p, f"d {i}") for i, p in enumerate(range(0, 400, 10))], shape)
    first = live.number_batch(again, 3, str(tmp_path / "folder" / "counts"), F.lit(got["folder"][0].source_id)).collect()
    assert {tuple(r) for r in first} <= {tuple(r) for r in got["folder"]} and len(first) == 40


def test_files_that_are_sources_need_no_counts(spark, tmp_path):
    """Where a file is a source, a batch is numbered by itself: nothing grows from batch to batch."""
    (tmp_path / "in").mkdir()
    for name, n in (("a", 300), ("b", 1), ("c", 40)):
        (tmp_path / "in" / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(n)))
    live.stream_numbered(stream_lines(spark, str(tmp_path / "in"), max_files=1), str(tmp_path / "out"), str(tmp_path / "counts"), str(tmp_path / "state"),
                         available_now=True, block_bytes=128).awaitTermination()
    got = spark.read.schema("source_id string, line_num long, raw string").parquet(str(tmp_path / "out")).drop("batch")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in read_lines(spark, str(tmp_path / "in")).collect()} and got.count() == 341
    assert not (tmp_path / "counts").exists()


def write_fed(spark, rows, files, tmp_path):
    """The rows as a stream, one micro-batch for each file number in ``files``."""
    lines = folds.lines(spark, rows)
    for i in range(max(files) + 1):
        folds.lines(spark, [r for r, f in zip(rows, files) if f == i]).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    return (spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
            .parquet(str(tmp_path / "in")))


END = 100_000


@pytest.fixture
def late(spark, tmp_path):
    """Three files with a third of the rows one file late; the last lines, far ahead in time, make the watermark pass all others."""
    rng = random.Random(5)
    rows = random_lines(23, 150)
    files = [min(2, i // 50 + (rng.random() < 0.3)) for i in range(150)]
    rows += [(s, END, 60 * 10**9, "x", "m2") for s in "ab"]
    stream = write_fed(spark, rows, files + [2, 2], tmp_path)
    assert any(a > b for a, b in zip(files, files[1:]))
    return stream, folds.lines(spark, rows), str(tmp_path / "out"), str(tmp_path / "state")


def test_late_burst_equals_batch(late):
    stream, lines, out, state = late
    got = live.run_available(stateful.stream_burst(stream, "tag", 60, 3, delay="5 seconds"), out, state).collect()
    want = batch.burst_detect(lines, "tag", 60, 3, line="current").filter(F.col("line_num") < END).collect()
    key = lambda r: (r.source_id, r.burst_key, r.line_num, r.ts_ns)
    assert sorted(map(key, got)) == sorted(map(key, want)) and want


def test_late_track_equals_batch(late):
    stream, lines, out, state = late
    defaults = {"a": None, "b": "", "c": False}
    got = tracker.flat_changes(live.run_available(stateful.stream_track(stream, spark_rules(), defaults, delay="5 seconds"), out, state)).collect()
    want = tracker.flat_changes(tracker.track_state(lines, spark_rules(), defaults)).filter(F.col("line_num") < END).collect()
    key = lambda r: (r.source_id, r.line_num, r.ts_ns, r.transition, r.field, str(r.from_value), str(r.to_value))
    assert sorted(map(key, got)) == sorted(map(key, want)) and want


@pytest.mark.parametrize("window", [(40, 400), (40, None), (None, 400), (None, None)])
@pytest.mark.parametrize("trigger_first", [True, False])
def test_late_correlate_equals_batch(late, window, trigger_first):
    stream, lines, out, state = late
    src = spark_sources()
    args = (src["t"], [src["c"], src["d"]], *window)
    got = live.run_available(stateful.stream_correlate(stream, *args, trigger_first=trigger_first, delay="5 seconds"), out, state).collect()
    want = (correlation_matches(lines, *args, trigger_first=trigger_first).filter(F.col("trigger_line") < END)
            .groupBy("source_id", "trigger_line").count().collect())
    assert sorted((r.source_id, r.trigger_line, r.matches) for r in got) == sorted((r.source_id, r.trigger_line, r["count"]) for r in want) and want


def test_times_keep_their_nanoseconds(spark, tmp_path):
    """A line without a time beside one whose time needs all 64 bits."""
    at = 1_704_164_645_123_456_789
    rows = [("s", 1, at, "x", "m1"), ("s", 2, None, "x", "m3")]
    out = live.run_available(stateful.stream_track(write_fed(spark, rows, [0, 0], tmp_path), spark_rules(), {"a": None, "b": "", "c": False}),
                             str(tmp_path / "out"), str(tmp_path / "state"))
    assert [(r.line_num, r.ts_ns) for r in out.orderBy("line_num").collect()] == [(1, at), (2, None)]


def state_rows(df, tmp_path):
    q = (df.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_unbounded_correlation_keeps_one_entry_a_cause(spark, tmp_path):
    src = spark_sources()
    rows = [("a", i, i * 10**6, "z", "m3") for i in range(400)]
    stream = write_fed(spark, rows, [i // 200 for i in range(400)], tmp_path)
    assert state_rows(stateful.stream_correlate(stream, src["t"], [src["c"]]), tmp_path) <= 2


def test_time_window_lets_old_causes_go(spark, tmp_path):
    src = spark_sources()
    rows = [("a", i, i * 10**9, "z", "m3") for i in range(400)]
    stream = write_fed(spark, rows, [i // 100 for i in range(400)], tmp_path)
    kept = state_rows(stateful.stream_correlate(stream, src["t"], [src["c"]], within_ms=5000, delay="10 seconds"), tmp_path)
    assert kept < 60


def test_idle_keys_and_delay_exclude_each_other(fed):
    with pytest.raises(ValueError):
        stateful.stream_burst(fed[0], "tag", idle_timeout_ms=10, delay="1 second")


def test_token_map_is_read_from_few_folders(spark, tmp_path):
    for n in range(200):
        spans = live.map_spans(n)
        assert len(spans) <= n.bit_length() and sorted(i for a, b in spans for i in range(a, b)) == list(range(n))
    options = {"categories": (), "custom": {"PII": r"m\d+"}}
    batches = [folds.lines(spark, [("a", b * 10 + i, 0, "x", f"say m{(b * 3 + i) % 17} m{b}") for i in range(4)]) for b in range(6)]
    path = str(tmp_path / "map")
    first = [sorted(map(tuple, live.mask_batch(df, b, path, **options).select("line_num", "message").collect())) for b, df in enumerate(batches)]
    tokens = {r.raw: r.token for r in live.read_token_map(spark, path, 6).collect()}
    assert live.read_token_map(spark, path, 6).count() == len(tokens) == len(set(tokens.values())) == 17
    for b in (3, 5):
        again = sorted(map(tuple, live.mask_batch(batches[b], b, path, **options).select("line_num", "message").collect()))
        assert again == first[b]
    assert {r.raw: r.token for r in live.read_token_map(spark, path, 6).collect()} == tokens


def test_new_matches_by_batch(spark, tmp_path, fed):
    stream, lines, out, state = fed
    live.stream_new_matches(stream, {"x": F.col("tag") == "x"}, out, state, available_now=True).awaitTermination()
    got = {r.batch_id: r.new for r in spark.read.option("recursiveFileLookup", "true").parquet(out).collect()}
    want = {i: spark.read.parquet(str(tmp_path / "in" / f"p{i}")).filter("tag = 'x'").count() for i in range(3)}
    assert got == want and all(want.values())


def test_sink_counts_a_batch_once_and_fences_old_runs(spark, tmp_path):
    path, rows = str(tmp_path / "out"), lambda *n: spark.createDataFrame([(i,) for i in n], "n int")
    schema = rows(1).schema
    got = lambda: sorted(r.n for r in read_committed(spark, path).collect())
    with pytest.raises(FileNotFoundError):
        read_committed(spark, path)
    old = FencedSink.claim(spark, path, "a", schema)
    assert got() == []
    old.write(rows(1, 2), 0)
    old.write(rows(9), 0)
    assert got() == [1, 2]
    restarted = FencedSink.claim(spark, path, "a", schema)
    with pytest.raises(Fenced):
        old.write(rows(3), 1)
    restarted.write(rows(1, 2), 0)
    restarted.write(rows(4), 1)
    assert got() == [1, 2, 4]
    new = FencedSink.claim(spark, path, "b", schema)
    new.write(rows(7), 0)
    with pytest.raises(Fenced):
        restarted.write(rows(5), 2)
    assert got() == [7]
    totals = FencedSink.claim(spark, path, "c", schema, "complete")
    totals.write(rows(1), 0)
    totals.write(rows(1, 2), 1)
    assert got() == [1, 2]


def test_overlapping_runs(spark, tmp_path, fed):
    """A run that never ends is fenced off by a start under other rules; its late batch does not reach readers."""
    stream, lines, out, state = fed
    pick = lambda tag: stream.filter(F.col("tag") == tag).select("source_id", "line_num", "tag")
    old = live.start_stream(pick("x"), out, state, "q", ("x",), interval="200 milliseconds")
    old.processAllAvailable()
    assert read_committed(spark, out).count() == lines.filter("tag = 'x'").count()
    live.start_stream(pick("y"), out, state, "q", ("y",)).awaitTermination()
    folds.lines(spark, [("a", 9999, 0, "x", "m1"), ("a", 9998, 0, "y", "m1")]).coalesce(1).write.parquet(str(tmp_path / "in" / "p9"))
    with pytest.raises(StreamingQueryException, match="taken over"):
        old.awaitTermination(60)
    live.start_stream(pick("y"), out, state, "q", ("y",)).awaitTermination()
    got = sorted((r.source_id, r.line_num) for r in read_committed(spark, out).collect())
    want = sorted((r.source_id, r.line_num) for r in lines.filter("tag = 'y'").collect()) + [("a", 9998)]
    assert got == sorted(want)


def test_late_parts_of_several_files(spark, tmp_path):
    """A part that was written as several files is still one step of the stream, so none of its rows is too late."""
    from queries import QUERIES
    small = "/root/testdata/sf0.001"
    spark.read.parquet(f"{small}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    want, got = (sorted(map(str, QUERIES["stream_track_late"](spark, sf).collect())) for sf in (small, str(tmp_path)))
    assert got == want and len(got) > 50


def test_waiting_rows_are_kept_in_runs():
    class Kept(list):
        get, appendList = (lambda self: iter(list(self))), list.extend

    class Clock:
        now = 0
        registerTimer = lambda self, ms: None
        getCurrentWatermarkInMs = lambda self: self.now
    p, clock, seen = stateful.BurstState(1000, 3, None, True), Clock(), []
    p.waiting, p.handle, p.apply = Kept(), clock, lambda key, rows: seen.extend(rows) or []
    rows = [(n, n * 10**6) for n in range(3000)]
    p.release(("s", "k"), clock, rows[1::2])
    p.release(("s", "k"), clock, rows[::2])
    assert len(p.waiting) == 4 and not seen
    clock.now = 2000
    p.release(("s", "k"), clock, [])
    assert seen == rows[:2000] and len(p.waiting) == 1 and list(zip(*p.waiting[0])) == rows[2000:]
