"""A Parquet sink that streams can be restarted into while an older run is still alive.

Each start of a stream claims the next epoch, a small file that can be created once. A micro-batch is written to a folder of
its own epoch and becomes visible by one commit file per generation and batch id, also created once; a generation is the
query name, rule set and checkpoint. So

* a batch that is run again, or run by two starts of one generation, counts once: the first commit stays;
* a run that is no longer the newest stops with ``Fenced`` at its next batch, and what it may still commit belongs to its own
  generation, which readers of a newer one never look at. This does not depend on when the old run notices.

Creating without overwriting is atomic on HDFS and on stores that offer a conditional put.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Fenced(RuntimeError):
    """A newer run has taken over the sink."""


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _fs(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, name: str) -> bool:
    return _fs(spark, name).exists(_path(spark, name))


def _create(spark: SparkSession, name: str, body: dict) -> bool:
    """Write a small file unless it exists; whether it was written."""
    if _exists(spark, name):
        return False
    try:
        out = _fs(spark, name).create(_path(spark, name), False)
    except Exception:
        if _exists(spark, name):
            return False
        raise
    try:
        out.write(bytearray(json.dumps(body).encode()))
    finally:
        out.close()
    return True


def _newest_epoch(spark: SparkSession, path: str) -> int:
    """The newest claimed epoch, -1 without any; epochs have no gaps."""
    if not _exists(spark, f"{path}/epochs"):
        return -1
    return max((int(s.getPath().getName().split(".")[0]) for s in _fs(spark, path).listStatus(_path(spark, f"{path}/epochs"))
                if s.getPath().getName().endswith(".json")), default=-1)


@dataclass(frozen=True)
class FencedSink:
    """The sink as one run holds it."""

    path: str
    generation: str
    epoch: int

    @staticmethod
    def claim(spark: SparkSession, path: str, generation: str, schema: StructType, mode: str = "append") -> FencedSink:
        epoch = _newest_epoch(spark, path) + 1
        body = {"generation": generation, "schema": schema.json(), "mode": mode, "run": uuid.uuid4().hex}
        while not _create(spark, f"{path}/epochs/{epoch}.json", body):
            epoch += 1
        return FencedSink(path, generation, epoch)

    def check(self, spark: SparkSession) -> None:
        if _exists(spark, f"{self.path}/epochs/{self.epoch + 1}.json"):
            raise Fenced(f"epoch {self.epoch} of {self.path} was taken over by a newer run")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Write and commit one micro-batch (for ``foreachBatch``)."""
        spark = batch.sparkSession
        self.check(spark)
        commit = f"{self.path}/commits/{self.generation}/{batch_id}.json"
        if _exists(spark, commit):
            return
        folder = f"data/{self.generation}/batch-{batch_id}-epoch-{self.epoch}"
        batch.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        self.check(spark)
        _create(spark, commit, {"batch": batch_id, "folder": folder})


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest run's generation: all its committed batches, or the last one in complete mode."""
    epoch = _newest_epoch(spark, path)
    if epoch < 0:
        raise FileNotFoundError(f"no stream was started into {path}")
    run = spark.read.schema("generation string, schema string, mode string").json(f"{path}/epochs/{epoch}.json").first()
    schema = StructType.fromJson(json.loads(run["schema"]))
    folder = f"{path}/commits/{run['generation']}"
    commits = spark.read.schema("batch long, folder string").json(folder).orderBy("batch").collect() if _exists(spark, folder) else []
    folders = [f"{path}/{c['folder']}" for c in (commits[-1:] if run["mode"] == "complete" else commits)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
