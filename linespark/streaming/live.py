"""Stateless and aggregating stream operators, and how streams are started."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import interval_ns
from ..operators.ordered import rank_lines, settle
from ..operators.pii import assign_tokens, detect_pii, mask_text
from ..operators.project import emit
from ..schemas import PII_MAP
from .fenced import FencedSink


def stream_emit(df: DataFrame, where: Column, **exprs: Column) -> DataFrame:
    """Result rows of matching lines, append mode."""
    return emit(df.filter(where), **exprs)


def stream_filter(df: DataFrame, where: Column) -> DataFrame:
    """A live filter: matches grow as lines arrive."""
    return df.filter(where)


def stream_transform(df: DataFrame, **exprs: Column) -> DataFrame:
    """Rewrite fields; live transformers never drop lines."""
    return df.withColumns(exprs)


def stream_summarize(df: DataFrame, specs: dict[str, Column], keys=("source_id",)) -> DataFrame:
    """Accumulators over all lines so far: update or complete mode."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in specs.items()])


def stream_watch(df: DataFrame, watches: dict[str, Column]) -> DataFrame:
    """Matches per watch so far. Each line is tested once against all watches."""
    hits = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(i)) for i, c in watches.items()]), lambda w: w.isNotNull())
    return df.select(F.explode(hits).alias("watch")).groupBy("watch").agg(F.count("*").alias("total"))


def watch_batch(batch: DataFrame, watches: dict[str, Column]) -> DataFrame:
    """New matches per watch in one micro-batch (for ``foreachBatch``)."""
    return stream_watch(batch, watches).withColumnRenamed("total", "new")


def stream_new_matches(df: DataFrame, watches: dict[str, Column], path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """New matches of each micro-batch as rows ``batch_id, watch, new``; a re-run batch overwrites its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        watch_batch(batch, watches).select(F.lit(batch_id).cast("bigint").alias("batch_id"), "watch", "new").write.mode("overwrite").parquet(
            f"{path}/part-{batch_id}")
    w = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if available_now else w).start()


def stream_metadata(df: DataFrame) -> DataFrame:
    """Lines, bytes, first and last time per source so far."""
    return df.groupBy("source_id").agg(
        F.count("*").alias("total_lines"), F.sum(F.octet_length("raw") + 1).alias("bytes"),
        F.min_by("ts_ns", F.when(F.col("ts_ns").isNotNull(), F.col("line_num"))).alias("first_ts_ns"),
        F.max("ts_ns").alias("last_ts_ns"))


def stream_count_by_time(df: DataFrame, interval: str, delay: str = "10 minutes", by: str | None = None) -> DataFrame:
    """Tumbling counts in event time; lines later than ``delay`` are left out deterministically."""
    width = interval_ns(interval)
    timed = df.filter("ts_ns IS NOT NULL").withColumn("_ts", F.timestamp_micros(F.expr("ts_ns div 1000")))
    keys = [F.window("_ts", f"{width // 1000} microseconds")]
    if by:
        keys.append(F.col(by))
    counts = timed.withWatermark("_ts", delay).groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.select((F.unix_micros("window.start") * 1000).alias("bucket"), *([by] if by else []), "n")


def map_spans(batches: int) -> list[tuple[int, int]]:
    """Spans [first, end) of the token-map folders that together cover the first ``batches`` micro-batches.

    The folder that batch ``n`` writes covers the last ``lowbit(n + 1)`` batches up to it, so any prefix is read from as
    many folders as its number has one bits, and a value is written again log n times at most.
    """
    out = []
    while batches:
        first = batches & (batches - 1)
        out.append((first, batches))
        batches = first
    return out


def read_token_map(spark: SparkSession, map_path: str, batches: int) -> DataFrame:
    """Tokens given in the first ``batches`` micro-batches of ``stream_mask``."""
    spans = map_spans(batches)
    if not spans:
        return spark.createDataFrame([], PII_MAP)
    return spark.read.schema(PII_MAP).parquet(*[f"{map_path}/batches-{a}-{b}" for a, b in spans])


def mask_batch(batch: DataFrame, batch_id: int, map_path: str, text: str = "message", **options) -> DataFrame:
    """Masked lines of one micro-batch, with tokens stable across batches.

    The seed is the map of all earlier batches. New values go, together with those of the folders that this one stands for
    (``map_spans``), to one new folder; earlier folders are never changed, so a repeated batch reads the same seed, gives the same
    tokens and overwrites its own folder only. The returned lines read the map as written.
    """
    spark = batch.sparkSession
    spans = settle(detect_pii(batch, text, **options))
    seed = read_token_map(spark, map_path, batch_id)
    new = assign_tokens(spans, seed).join(seed.select("raw"), "raw", "left_anti").select(*PII_MAP.fieldNames())
    first, end = map_spans(batch_id + 1)[0]
    for a, b in map_spans(batch_id):
        if a >= first:
            new = new.unionByName(spark.read.schema(PII_MAP).parquet(f"{map_path}/batches-{a}-{b}"))
    new.write.mode("overwrite").parquet(f"{map_path}/batches-{first}-{end}")
    return mask_text(batch, spans, read_token_map(spark, map_path, batch_id + 1), text)


def stream_mask(df: DataFrame, map_path: str, out_path: str, checkpoint: str, text: str = "message", available_now: bool = False,
                **options) -> StreamingQuery:
    """Mask a stream to parquet; re-run batches overwrite their own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        mask_batch(batch, batch_id, map_path, text, **options).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
    w = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if available_now else w).start()


#: Lines of so many bytes of a file are put in order by one task.
BLOCK_BYTES = 1 << 27
COUNTED = "source_id string, n long"
PLACED = "file string, source_id string, n long, first long"


def number_batch(batch: DataFrame, batch_id: int, counts_path: str, source: Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Lines of one micro-batch of ``sources.text.stream_lines`` with numbers contiguous from 0 per source, as ``read_lines`` gives them.

    A source is a file, or what ``source`` makes of the file's path in ``source_id``: a folder that a capture writes one file after another
    into is one source whose numbers go on from batch to batch. Files of a batch are numbered in order of their paths.

    A file comes whole in one batch, so a line's number is the lines of its source in earlier batches, those of the source's earlier
    files in this batch, and its rank in its file by byte place (a block scan). Batch ``n`` reads the line counts that batch ``n - 1`` left and
    writes its own, one row a source; a repeated batch reads and writes the same. Where a file is a source there is nothing to carry: the rank
    is the number, and a batch neither counts first nor reads or writes counts.
    """
    spark = batch.sparkSession
    if source is None:
        return rank_lines(batch, "_rank", block_lines=block_bytes).select("source_id", F.col("_rank").alias("line_num"), "raw")
    lines = batch.withColumnRenamed("source_id", "file")
    files = batch.groupBy("source_id").agg(F.count("*").alias("n")).select(F.col("source_id").alias("file"), source.alias("source_id"), "n")
    before = spark.read.schema(COUNTED).parquet(f"{counts_path}/after-{batch_id - 1}") if batch_id else spark.createDataFrame([], COUNTED)
    earlier = W.partitionBy("source_id").orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    first = F.coalesce("_seen", F.lit(0)) + F.coalesce(F.sum("n").over(earlier), F.lit(0))
    files.join(before.withColumnRenamed("n", "_seen"), "source_id", "left").select("file", "source_id", "n", first.alias("first")).write.mode(
        "overwrite").parquet(f"{counts_path}/files-{batch_id}")
    # Read back, so that Spark knows its size when it chooses the join below: a small table does not move the lines.
    placed = spark.read.schema(PLACED).parquet(f"{counts_path}/files-{batch_id}")
    before.unionByName(placed.select("source_id", "n")).groupBy("source_id").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(
        f"{counts_path}/after-{batch_id}")
    ranked = rank_lines(lines, "_rank", keys=("file",), order=("line_num",), block_lines=block_bytes)
    return ranked.join(placed, "file").select("source_id", (F.col("first") + F.col("_rank")).alias("line_num"), "raw")


def stream_numbered(df: DataFrame, out_path: str, counts_path: str, checkpoint: str, source: Column | None = None, available_now: bool = False,
                    block_bytes: int = BLOCK_BYTES) -> StreamingQuery:
    """Number a stream of text lines to Parquet, one folder a batch; re-run batches overwrite their own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        number_batch(batch, batch_id, counts_path, source, block_bytes).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
    w = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if available_now else w).start()


def rule_name(name: str, rules) -> str:
    """Query name that changes with the rule set, so that state of old rules is never taken up again."""
    return f"{name}_{hashlib.sha256(repr(rules).encode()).hexdigest()[:12]}"


def start_stream(df: DataFrame, path: str, checkpoint_root: str, name: str, rules=(), mode: str = "append",
                 interval: str | None = None) -> StreamingQuery:
    """Start a stream into a fenced Parquet sink; read it with ``fenced.read_committed``.

    State is handed over by the checkpoint of this name and rule set only. A run of other rules, or an older run that is still
    alive, is fenced off from the moment this one starts.
    """
    query = rule_name(name, rules)
    checkpoint = f"{checkpoint_root}/{query}"
    generation = f"{query}_{hashlib.sha256(checkpoint.encode()).hexdigest()[:12]}"
    sink = FencedSink.claim(df.sparkSession, path, generation, df.schema, mode)
    w = df.writeStream.queryName(query).outputMode(mode).foreachBatch(sink.write).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)
    return w.start()


def run_available(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all input that is there, append mode, and read the result back."""
    q = (df.writeStream.outputMode("append").format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_totals(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all input of an aggregating stream and read its final totals back."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    q = (df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    last = (q.lastProgress or {}).get("batchId", 0)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/batch={last}")
