"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordered import ensure_checkpoint_dir

SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Write a table that several steps read to the shared folder, once, and read it back.

    Its rows cannot change when an executor is lost afterwards, and its lineage ends here.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply a function of one Arrow batch to every batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out
    return df.mapInArrow(run, schema)


_remembered: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What a Python worker remembers from task to task for one operator; what other operators left in the worker is given back first.

    Workers are used again by later operators, so memories would add up over a pipeline.
    """
    if owner not in _remembered:
        _remembered.clear()
        _remembered[owner] = {}
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)
    return _remembered[owner]


def safe_columns(df: DataFrame, added: list[str]) -> None:
    """Extra columns are carried along; one that has the name of a result column cannot be."""
    clash = sorted(set(df.columns) & set(added))
    if clash:
        raise ValueError(f"the input already has result columns {clash}; rename or drop them")


def crc32_of_id(column: str = "doc_id"):
    """crc32 of the id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


# -- 64-bit hashes of words, computed for a whole batch of texts at once --------------------------------------------

_SEED = np.random.default_rng(20240607)
_BYTE = _SEED.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
PIECE = 1 << 18


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_P), -1, 2**64))
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (_P, inverse)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h.copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text: equal words have equal hashes wherever they stand.

    A long text is hashed piece by piece, cut at blanks, so that memory grows with its longest word only.
    """
    if len(text) <= 2 * PIECE:
        return _piece_hashes(text)
    out, start = [], 0
    while start < len(text):
        blank = _BLANK.search(text, start + PIECE)
        end = blank.end() if blank else len(text)
        out.append(_piece_hashes(text[start:end]))
        start = end
    return np.concatenate(out)


def _piece_hashes(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    inside = ~_IS_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    start, end = edge[::2], edge[1::2]
    up, down = _power_tables(len(b) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[b] * up[:len(b)], dtype=np.uint64)])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; the whole sequence as one run when it is shorter, none without words."""
    if not len(words):
        return words
    n_here = min(n, len(words))
    out = np.full(len(words) - n_here + 1, np.uint64(n_here), np.uint64)
    for i in range(n_here):
        out = out * _P + words[i:len(words) - n_here + 1 + i]
    return mix(out)


def each_text(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    for x in column:
        v = x.as_buffer() if x.is_valid else None
        yield v.to_pybytes() if v is not None else b""
