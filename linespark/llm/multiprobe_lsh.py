"""Approximate nearest neighbours by inner product with multiprobe p-stable hashing.

Largest inner product becomes smallest distance by one more coordinate that brings every vector to the longest norm.  Each
of ``tables`` hash tables cuts ``hashes`` random projections (Gaussian, so 2-stable) into cells of ``width``.  A query
visits, in every table, the ``probes`` buckets that are likeliest to hold near vectors: sets of moves to neighbouring cells in the
order of their expected squared distances to the query, mapped onto the query's own distances to its cell walls.

Buckets are dealt out in *groups* of a bounded number of vectors (a group that is larger, as one bucket may be, is split
and its queries go to every part).  In a group the exact inner products of each query with its visited buckets are
computed in double precision and only the best ``k + 1`` leave it, so no list of candidates is ever shuffled or capped.
Equal vectors take part only with their ``k + 1`` smallest ids, since no other can be among the ``k`` nearest.  A query that found
fewer than ``k`` is compared with all vectors, block by block.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import keep, map_batches

TABLES = 12
HASHES = 12
WIDTH = 3.0
PROBES = 72
K = 20
GROUP_ROWS = 60_000


def probe_sets(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of wall ranks (0: the nearest wall) in the order of their expected score, never both walls of one projection."""
    n = 2 * hashes
    expected = [(j * (j + 1)) / (4 * (hashes + 1) * (hashes + 2)) if j <= hashes else
                1 - (n + 1 - j) / (hashes + 1) + ((n + 1 - j) * (n + 2 - j)) / (4 * (hashes + 1) * (hashes + 2)) for j in range(1, n + 1)]
    out: list[tuple[int, ...]] = [()]
    heap = [(expected[0], (0,))]
    while heap and len(out) < probes:
        score, walls = heapq.heappop(heap)
        if len({min(x, n - 1 - x) for x in walls}) == len(walls):
            out.append(walls)
        if walls[-1] + 1 < n:
            last = walls[-1]
            heapq.heappush(heap, (score + expected[last + 1], (*walls, last + 1)))
            heapq.heappush(heap, (score + expected[last + 1] - expected[last], (*walls[:-1], last + 1)))
    return out


class Hasher:
    """The hash tables for vectors of one dimension, the same in every task."""

    def __init__(self, dim: int, longest: float, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES):
        rng = np.random.default_rng([2004, dim])
        self.axes = rng.standard_normal((tables, dim + 1, hashes))
        self.shift = rng.uniform(0, 1, (tables, hashes))
        self.mixing = rng.integers(1, 2**63, hashes, dtype=np.int64) | 1
        self.longest, self.width, self.sets = longest, width, probe_sets(hashes, probes)

    def _cells(self, x: np.ndarray, table: int) -> np.ndarray:
        return x @ self.axes[table] / self.width + self.shift[table]

    def _key(self, cells: np.ndarray) -> np.ndarray:
        return (cells * self.mixing).sum(-1)

    def index(self, v: np.ndarray) -> np.ndarray:
        """Bucket key of each vector in each table."""
        scaled = v / self.longest
        x = np.hstack([scaled, np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(1)))[:, None]])
        return np.stack([self._key(np.floor(self._cells(x, t)).astype(np.int64)) for t in range(len(self.axes))], 1)

    def probe(self, q: np.ndarray) -> list[list[np.ndarray]]:
        """For each table and query, the keys of the buckets to visit."""
        x = np.hstack([q / np.linalg.norm(q, axis=1)[:, None], np.zeros((len(q), 1))])
        out = []
        for t in range(len(self.axes)):
            at = self._cells(x, t)
            home = np.floor(at).astype(np.int64)
            inside = at - home
            walls = np.argsort(np.hstack([inside, 1 - inside]), axis=1, kind="stable")
            n, keys = inside.shape[1], []
            step = np.concatenate([-self.mixing, self.mixing])
            for h, w in zip(self._key(home), step[walls]):
                keys.append(np.unique(np.array([h + w[list(s)].sum() for s in self.sets], np.int64)))
            out.append(keys)
        return out


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, embedding, dim`` of vectors that take part: not null or zero, every component finite."""
    x = F.col(vector_column).cast("array<double>")
    fine = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))) & F.exists(x, lambda e: e != 0)
    return vectors.filter(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("vec_id"), x.alias("embedding")).filter(fine).withColumn("dim", F.size("embedding"))


def nearest(vectors: DataFrame, is_query, k: int = K, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES,
            group_rows: int = GROUP_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row for which ``is_query`` (a Column over ``vec_id``) holds, its ``k`` nearest found other rows.

    Largest inner product first, ties to the smaller ``vec_id``. Null, zero and non-finite vectors neither ask nor are found; vectors are compared with those of their own
    dimension. Fewer rows come back only where there are fewer candidates. Ids are distinct; other columns are not read. An empty table gives an empty result.
    """
    all_rows = keep(usable(vectors))
    norms = all_rows.groupBy("dim").agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, e: a + e * e)).alias("n"), F.count("*").alias("rows")).collect()  # one row per dimension
    hashers = {r["dim"]: Hasher(r["dim"], r["n"] ** 0.5, tables, hashes, width, probes) for r in norms}
    n_groups = max(1, -(-max([r["rows"] for r in norms], default=1) // group_rows))
    equal = W.partitionBy("embedding").orderBy("vec_id")
    indexed = all_rows.withColumn("_nth", F.row_number().over(equal)).filter(F.col("_nth") <= k + 1).drop("_nth")
    asking = all_rows.filter(is_query)
    spread_over = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows, much work for each
    questions = keep(asking.groupBy("embedding", "dim").agg(F.min("vec_id").alias("qid")).repartition(spread_over, "qid"))

    def dims(b: pa.RecordBatch):
        d = b.column(b.schema.get_field_index("dim")).to_numpy()
        for dim in np.unique(d):
            yield int(dim), b.filter(pa.array(d == dim))

    def index(b: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for dim, part in dims(b):
            keys = hashers[dim].index(_matrix(part.column(1)))
            n = len(part)
            parts.append(pa.table({"dim": np.full(n * tables, dim, np.int32), "tab": np.repeat(np.arange(tables, dtype=np.int32), n),
                                   "bucket": keys.T.ravel(), "vec_id": pa.concat_arrays([part.column(0)] * tables), "embedding": pa.concat_arrays([part.column(1)] * tables)}))
        return pa.concat_tables(parts).combine_chunks().to_batches()[0]

    def ask(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for dim, part in dims(b):
            ids, vectors_ = part.column(2).to_pylist(), part.column(0)
            for tab, per_query in enumerate(hashers[dim].probe(_matrix(vectors_))):
                for i, keys in enumerate(per_query):
                    group = np.mod(keys, n_groups)
                    for g in np.unique(group):
                        rows.append((dim, tab, int(g), ids[i], vectors_[i].as_py(), keys[group == g].tolist()))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["dim", "tab", "grp", "qid", "embedding", "buckets"])

    def compare(key, found, asked):
        out_q, out_v, out_s = [], [], []
        if found.num_rows and asked.num_rows:
            v, ids, bucket = _matrix(found.column("embedding")), found.column("vec_id").to_numpy(), found.column("bucket").to_numpy()
            order = np.lexsort((ids, bucket))
            v, ids, bucket = v[order], ids[order], bucket[order]
            q, visited = _matrix(asked.column("embedding")), asked.column("buckets").to_pylist()
            for i, qid in enumerate(asked.column("qid").to_pylist()):
                if visited[i] is None:
                    at = np.arange(len(ids))
                else:
                    lo, hi = np.searchsorted(bucket, visited[i], "left"), np.searchsorted(bucket, visited[i], "right")
                    at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)] or [np.empty(0, int)])
                if not len(at):
                    continue
                # einsum adds in one order whatever else is in the group, so equal vectors have equal scores.
                score = np.einsum("ij,j->i", v[at], q[i])
                if len(at) > k + 1:
                    edge = np.partition(score, len(at) - k - 1)[len(at) - k - 1]
                    near = score >= edge
                    at, score = at[near], score[near]
                best = np.lexsort((ids[at], -score))[:k + 1]
                out_q.append(np.full(len(best), qid)), out_v.append(ids[at][best]), out_s.append(score[best])
        join = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.empty(0, t)
        return pa.table({"qid": join(out_q, np.int64), "vec_id": join(out_v, np.int64), "score": join(out_s, np.float64)})

    placed = keep(map_batches(indexed.select("vec_id", "embedding", "dim"), index, "dim int, tab int, bucket bigint, vec_id bigint, embedding array<double>")
                  .withColumn("grp", F.pmod("bucket", F.lit(n_groups))))
    parts = keep(placed.groupBy("dim", "tab", "grp").count().withColumn("_parts", F.ceil(F.col("count") / (2 * group_rows)).cast("int")).drop("count"))
    cut = placed.join(parts, ["dim", "tab", "grp"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("_parts")).cast("int")).drop("_parts")

    def answers(asked: DataFrame) -> DataFrame:
        spread = asked.join(parts, ["dim", "tab", "grp"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        names = ["dim", "tab", "grp", "part"]
        best = cut.groupBy(*names).cogroup(spread.groupBy(*names)).applyInArrow(compare, "qid bigint, vec_id bigint, score double")
        return best.groupBy("qid", "vec_id").agg(F.max("score").alias("score"))

    first = keep(answers(map_batches(questions.select("embedding", "dim", "qid"), ask, "dim int, tab int, grp bigint, qid bigint, embedding array<double>, buckets array<bigint>")))
    # Whoever found too few asks every group of one table.
    enough = first.groupBy("qid").count().filter(F.col("count") > k).select("qid")
    short = keep(questions.join(enough, "qid", "left_anti"))
    found = first
    if short.limit(1).count():
        everywhere = short.join(parts.filter("tab = 0").select("dim", "tab", "grp"), "dim").select("dim", "tab", "grp", "qid", "embedding", F.lit(None).cast("array<bigint>").alias("buckets"))
        found = first.join(short, "qid", "left_anti").unionByName(answers(everywhere))
    by_question = W.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("_n", F.row_number().over(by_question)).filter(F.col("_n") <= k + 1).drop("_n")
    members = asking.join(questions, ["embedding", "dim"]).select("qid", F.col("vec_id").alias("query_id"))
    own = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = members.join(top, "qid").filter("query_id <> vec_id").withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
