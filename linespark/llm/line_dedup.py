"""Reversible incremental line dedup: exact reference counts, screened by sharded cuckoo filters.

A *reference* is one row ``(key, doc_id)``: the document holds a line with that key.  References are the exact state;
inserting documents appends their references, deleting documents removes theirs, so every state can be reached back.
Counts (documents per key, largest holder) come from them by one aggregation that combines before the shuffle.

Keys held by enough documents are *blocked*.  Each shard of the key space has a cuckoo filter of its blocked keys.  A
batch of documents asks the filters first with its distinct keys; only keys that pass are looked up in the exact
counts, so a filter may say yes wrongly but no line is ever dropped by it alone.  Filters take insertions and
deletions, so they follow the counts without a rebuild.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import each_text, keep, map_batches, safe_columns

MIN_CHARS = 20
MIN_DOCS = 3
SLOTS = 4
KEYS_PER_SHARD = 200_000
#: Keys that one task asks a filter at most, on average.
ASKED_PER_PART = 200_000
SLICE = 10_000
_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends and with A-Z lower-cased."""
    return line.strip(_STRIP).lower()


def _n_chars(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, key, at``: each distinct long key of a document (16-byte digest) and the places of its lines.

    Null or empty texts and short lines give no rows. A document given twice gives its rows twice.
    """
    def keys(b: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, digests, places = [], [], []
        for doc, text in zip(b.column(0).to_pylist(), each_text(b.column(1))):
            found: dict[bytes, list[int]] = {}
            for i, line in enumerate(text.split(b"\n")):
                k = line_key(line)
                if len(k) >= min_chars and _n_chars(k) >= min_chars:
                    found.setdefault(k, []).append(i)
            ids += [doc] * len(found)
            digests += [hashlib.blake2b(k, digest_size=16).digest() for k in found]
            places += found.values()
        if not ids:
            return None
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(places, pa.list_(pa.int32()))], ["doc_id", "key", "at"])
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), keys, "doc_id bigint, key binary, at array<int>")


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``key, doc_id``: the exact state of these documents."""
    return line_keys(docs, min_chars).select("key", "doc_id")


def insert(refs: DataFrame, docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """References after adding documents; one that is already there is added once."""
    return refs.unionByName(references(docs, min_chars)).distinct()


def delete(refs: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """References without those of the given ``doc_id``s."""
    return refs.join(doc_ids.select(F.col("doc_id").cast("bigint")).distinct(), "doc_id", "left_anti").select("key", "doc_id")


def counts(refs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``key, n_docs, keeper``: keys held by at least ``min_docs`` documents and their largest holder.

    A document counts once however often its references are given; a null id is no document.
    """
    return refs.select("key", "doc_id").distinct().groupBy("key").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper")).filter(F.col("n_docs") >= min_docs)


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a fingerprint lives in one of two buckets, or in a small overflow list.

    Inserting moves at most ``MOVES`` fingerprints; one that finds no place goes to the overflow, so nothing is lost.
    """

    MOVES = 200
    #: Share of slots in use beyond which inserting gets slow and the overflow grows.
    FULL = 0.9

    def __init__(self, buckets: int):
        self.slots = np.zeros((1 << max(1, int(buckets - 1).bit_length()), SLOTS), np.uint16)
        self.overflow: list[tuple[int, int]] = []

    @classmethod
    def of(cls, keys, expected: int | None = None) -> CuckooFilter:
        f = cls(max(expected or 0, len(keys)) // 3 + 1)
        for k in keys:
            f.add(k)
        return f

    def _places(self, key: bytes) -> tuple[int, int, int]:
        fingerprint = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[:8], "little") & (len(self.slots) - 1)
        return fingerprint, first, self._other(first, fingerprint)

    def _other(self, bucket: int, fingerprint: int) -> int:
        return (bucket ^ (fingerprint * 0x5BD1E995)) & (len(self.slots) - 1)

    def add(self, key: bytes) -> None:
        fingerprint, a, b = self._places(key)
        for at in (a, b):
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = fingerprint
                return
        at = b
        for move in range(self.MOVES):
            slot = (fingerprint + move) % SLOTS
            fingerprint, self.slots[at, slot] = int(self.slots[at, slot]), fingerprint
            at = self._other(at, fingerprint)
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = fingerprint
                return
        self.overflow.append((min(at, self._other(at, fingerprint)), fingerprint))

    def discard(self, key: bytes) -> None:
        """Take out one copy of a key that was added."""
        fingerprint, a, b = self._places(key)
        if (min(a, b), fingerprint) in self.overflow:
            self.overflow.remove((min(a, b), fingerprint))
            return
        for at in (a, b):
            here = np.flatnonzero(self.slots[at] == fingerprint)
            if len(here):
                self.slots[at, here[0]] = 0
                return

    def __contains__(self, key: bytes) -> bool:
        fingerprint, a, b = self._places(key)
        return bool((self.slots[a] == fingerprint).any() or (self.slots[b] == fingerprint).any() or (min(a, b), fingerprint) in self.overflow)

    def outgrown(self) -> bool:
        return np.count_nonzero(self.slots) + len(self.overflow) > self.FULL * self.slots.size

    def to_bytes(self) -> bytes:
        tail = np.array(self.overflow, np.int64).reshape(-1, 2)
        return np.array([len(self.slots), len(tail)], np.int64).tobytes() + tail.tobytes() + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        n, over = np.frombuffer(data[:16], np.int64)
        f = cls(1)
        f.overflow = [tuple(map(int, x)) for x in np.frombuffer(data[16:16 + 16 * over], np.int64).reshape(-1, 2)]
        f.slots = np.frombuffer(data[16 + 16 * over:], np.uint16).reshape(n, SLOTS).copy()
        return f


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")


def build_filters(blocked: DataFrame, shards: int) -> DataFrame:
    """``shard, filter``: a cuckoo filter of each shard's keys. A shard's keys come together, so choose enough shards."""
    def build(key, t):
        f = CuckooFilter.of(t.column("key").to_pylist())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([f.to_bytes()], pa.binary())})
    return blocked.select(_shard(shards), "key").groupBy("shard").applyInArrow(build, "shard int, filter binary")


def update_filters(filters: DataFrame, added: DataFrame, removed: DataFrame, shards: int, blocked: DataFrame | None = None) -> DataFrame:
    """Filters after keys became blocked (``added``) or stopped being so (``removed``).

    Given ``blocked``, all keys that are blocked after the change, a shard that outgrew its filter gets one of twice the size or more, built from its keys.
    Without them the filter keeps its size: answers stay right, but keys beyond it go to the overflow list, which is searched from end to end.
    """
    def update(key, f, changes):
        new = [k for k, on in zip(changes.column("key").to_pylist(), changes.column("on").to_pylist()) if on]
        cuckoo = CuckooFilter.from_bytes(f.column("filter")[0].as_py()) if f.num_rows else CuckooFilter(len(new) // 3 + 1)
        for k, on in zip(changes.column("key").to_pylist(), changes.column("on").to_pylist()):
            cuckoo.add(k) if on else cuckoo.discard(k)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([cuckoo.to_bytes()], pa.binary()), "outgrown": pa.array([cuckoo.outgrown()])})
    changes = added.select("key", F.lit(True).alias("on")).unionByName(removed.select("key", F.lit(False).alias("on"))).select(_shard(shards), "key", "on")
    updated = filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(update, "shard int, filter binary, outgrown boolean")
    if blocked is None:
        return updated.drop("outgrown")
    updated = keep(updated)
    again = blocked.select("key").distinct().withColumn("shard", _shard(shards)).join(updated.filter("outgrown").select("shard"), "shard", "left_semi")
    return updated.filter("not outgrown").drop("outgrown").unionByName(build_filters(again.select("key"), shards))


def asking_parts(n_keys: int, shards: int) -> int:
    """Parts that the asked keys of a shard are cut into, so that a part has about ``ASKED_PER_PART`` however many are asked."""
    return max(1, -(-n_keys // (shards * ASKED_PER_PART)))


def screen(keys: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The distinct ``keys`` that a filter lets pass: all blocked ones and a few others.

    ``keys`` are counted first (so store them); each part of a shard's keys gets a copy of the shard's filter.
    """
    parts = asking_parts(keys.count(), shards)

    def ask(key, asked, f):
        if not f.num_rows:
            return pa.table({"key": pa.array([], pa.binary())})
        cuckoo = CuckooFilter.from_bytes(f.column("filter")[0].as_py())
        passed = [pa.array([k for k in b.column("key").to_pylist() if k in cuckoo], pa.binary()) for b in asked.select(["key"]).to_batches(SLICE)]
        return pa.table({"key": pa.chunked_array(passed, pa.binary())})
    asked = keys.select("key").distinct().select(_shard(shards), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(parts)).cast("int").alias("part"), "key")
    copies = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "filter")
    return asked.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(ask, "key binary")


def dedup_lines(docs: DataFrame, state: DataFrame | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                shards: int | None = None) -> DataFrame:
    """Drop lines whose key is held by ``min_docs`` documents or more, save in the largest ``doc_id`` that holds it.

    ``state`` are the references of all documents that count, these included (default: of ``docs`` alone). Adds
    ``n_lines`` and ``n_dropped`` and replaces ``text`` by the kept lines. Null or empty text is one empty line and becomes
    empty; repeated lines of the keeper stay. Rows that share a ``doc_id`` are one document when documents are counted, and each loses the dropped lines
    of its own text; a row with a null id counts as no document and keeps its lines. Other columns are kept; an
    empty table gives an empty table. Raises if ``docs`` already has ``n_lines`` or ``n_dropped``.
    """
    safe_columns(docs, ["n_lines", "n_dropped"])
    lines = keep(references(docs, min_chars))
    blocked = keep(counts(lines if state is None else state, min_docs))
    shards = shards or int(blocked.count() // KEYS_PER_SHARD) * 2 + 16
    passed = screen(lines, build_filters(blocked, shards), shards)
    verdict = blocked.join(passed, "key").select("key", "keeper")
    drops = (lines.join(verdict, "key").filter(F.col("doc_id") != F.col("keeper"))
             .groupBy("doc_id").agg(F.collect_set("key").alias("_drop")))
    return _without(docs, drops, min_chars)


def _without(docs: DataFrame, drops: DataFrame, min_chars: int) -> DataFrame:
    """Drop from each row's text the lines whose keys are in its document's ``_drop``."""
    columns = docs.columns
    joined = docs.join(drops.withColumnRenamed("doc_id", "_id"), F.col("doc_id").cast("bigint") == F.col("_id"), "left").drop("_id")
    fields = [f for f in joined.schema.fields if f.name not in ("text", "_drop")]
    names = [f.name for f in fields]

    def rewrite(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, lines, dropped = [], [], []
        for text, drop in zip(each_text(b.column("text")), b.column("_drop").to_pylist()):
            parts = text.split(b"\n")
            lines.append(len(parts))
            left = parts
            if drop:
                gone = set(drop)
                left = [p for p in parts if len(k := line_key(p)) < min_chars or hashlib.blake2b(k, digest_size=16).digest() not in gone]
                text = b"\n".join(left)
            dropped.append(len(parts) - len(left))
            texts.append(text)
        text = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*(b.column(n) for n in names), text, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                                          [*names, "text", "n_lines", "n_dropped"])
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    schema = StructType([*fields, StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    return joined.select(*names, "text", "_drop").mapInArrow(lambda bs: (rewrite(b) for b in bs), schema).select(*columns, "n_lines", "n_dropped")
