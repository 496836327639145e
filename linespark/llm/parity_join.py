"""Near-duplicate groups by a parity-sketch join.

A document is the set of hashes of its word shingles.  Each hash flips one bit of a wide bit sketch, so the Hamming
distance of two sketches never exceeds the size of the symmetric difference of the sets.  Two sets of at most ``hi``
shingles that reach the similarity differ in at most ``d = floor(2 hi (100 - p) / (100 + p))`` shingles.  A sketch is cut
into more than ``d`` parts, so a linked pair has an equal part: documents meet in an equi-join on (size band, part, bits of
the part).  The sketch is as wide as the hashes and nearly empty, so a part is kept as the XOR of its mixed set bits.

*Bands.* Sizes grow by half from band to band. A pair is sought in the band of its larger set; a document that can have
a larger partner across the edge also enters the next band.

*Empty parts* would make strangers meet and are left out, which loses nothing while a document has more than ``d`` parts
that are not empty.  One that has not enters another cut of the sketch too, with another seed; after ``LEVELS`` cuts it
enters with all its parts.

*Keys* are made for the first of equal sets in a task and go straight into the join: they are several times as large as the rest of what is known
of a document and are never stored. Only rows of a key that another document has too are kept, and these take the name of their class.

*Large groups.*  Equal sets are one class before anything else.  In a group of equal parts every document is verified
against the first, then against the one before it if their clusters differ, never against all.  Links found make clusters,
and only documents of different clusters in the same group are still open.  A large group that still is compares the whole sketches of its open
pairs block by block and lets only those pass that the distance bound allows.

*Stored sketches* have about as many bits as their sets have shingles: strangers of any length then differ in twice the bits that the bound
allows, so that sets, 64 times as large as their sketches, are fetched for little else than links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import each_text, keep, map_batches, mix, safe_columns, shingle_hashes, word_hashes, worker_cache

WORDS = 4
PERCENT = 85
LEVELS = 3
GROWTH = 1.5
SMALL_GROUP = 16
BLOCK = 2048
KEYS_AT_ONCE = 500_000
#: Bits of a stored sketch, at least and at most; sets of more shingles than the most are screened less sharply.
BITS, MOST_BITS = 1024, 1 << 16
#: Up to this size of its smallest sets the parts of a band are chosen by the exact chance that one cut has too few, which is to be below ``RARE``.
SHORT, RARE = 128, 1e-4
_U = np.uint64


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text with A-Z lower-cased."""
    return np.unique(shingle_hashes(word_hashes(text.lower()), words))


class Bands:
    """How many parts the sketches of each size band have, for one similarity in percent."""

    def __init__(self, percent: int):
        self.percent, self._parts = percent, {}

    def band(self, n: int) -> int:
        k, edge = 0, 6
        while n >= (edge := int(edge * GROWTH)):
            k += 1
        return k

    def edges(self, band: int) -> tuple[int, int]:
        lo = 6
        for _ in range(band):
            lo = int(lo * GROWTH)
        return (1 if band == 0 else lo), int(lo * GROWTH) - 1

    def differing(self, band: int) -> int:
        """The most shingles in which a linked pair with its larger set in the band differs."""
        return 2 * self.edges(band)[1] * (100 - self.percent) // (100 + self.percent)

    def smallest(self, band: int) -> int:
        """The least size that can have a partner in the band, other than an equal set."""
        n = max(1, -(-self.edges(band)[0] * self.percent // 100))
        while not self.of(n):
            n += 1
        return n

    @staticmethod
    def _rarely_short(n: int, m: int, need: int) -> bool:
        """Whether ``n`` bits in ``m`` parts leave fewer than ``need`` parts that are not empty less often than once in ``1 / RARE`` sets."""
        full = [1.0] + [0.0] * need  # chance of each number of parts in use; the last entry: enough
        for _ in range(n):
            full = [(full[k] * k / m if k < need else full[k]) + (full[k - 1] * (m - k + 1) / m if k else 0.0) for k in range(need + 1)]
        return sum(full[:need]) <= RARE

    def parts(self, band: int) -> int:
        """Parts so many that nearly every document of the band has enough that are not empty."""
        if band not in self._parts and (n := self.smallest(band)) <= SHORT:
            need = self.differing(band) + 1
            # More parts cost a short document no more keys, as it has no more keys than shingles.
            self._parts[band] = next((m for m in range(need, 64 * need + 64) if self._rarely_short(n, m, need)), 64 * need + 64)
        if band not in self._parts:
            need, n = self.differing(band) + 1, max(1, self.edges(band)[0] * self.percent // 100)
            best, at = None, need
            for m in range(need, 2 * need + 8):
                full = 1 - (1 - 1 / m) ** n
                margin = m * full - 3 * (m * full * (1 - full)) ** 0.5 - need
                if best is None or margin > best:
                    best, at = margin, m
                if margin >= 0:
                    break
            self._parts[band] = at
        return self._parts[band]

    def of(self, n: int) -> list[int]:
        """The bands that a set of ``n`` shingles enters; none when only equal sets can be linked with it."""
        own, widest = self.band(n), n * 100 // self.percent
        if widest == n and (n - 1) * 100 < n * self.percent:
            return []
        return [own] if self.band(widest) == own else [own, own + 1]


def sketch_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the sketch parts with which a set enters the join."""
    out = []
    for band in bands.of(len(shingles)):
        m, need = bands.parts(band), bands.differing(band) + 1
        for cut in range(LEVELS):
            bits = shingles if not cut else np.sort(mix(shingles ^ mix(np.array([cut], _U))))
            part = ((bits >> _U(32)) * _U(m)) >> _U(32)
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            content = np.bitwise_xor.reduceat(mix(bits), first)
            place = part[first]
            enough = len(first) >= need
            if not enough and cut == LEVELS - 1:
                empty = np.setdiff1d(np.arange(m, dtype=_U), place)
                place, content = np.concatenate([place, empty]), np.concatenate([content, np.zeros(len(empty), _U)])
            out.append(mix(content ^ mix(place + (_U(band * 64 + cut) << _U(40)))))
            if enough:
                break
    return np.concatenate(out) if out else np.empty(0, _U)


def parity_sketch(shingles: np.ndarray) -> bytes:
    """Bits in a number of the next power of two to the set's size, each flipped by every shingle that falls on it: the Hamming distance of
    two such sketches of one width is at most the number of differing shingles."""
    bits = min(MOST_BITS, max(BITS, 1 << (len(shingles) - 1).bit_length())) if len(shingles) else BITS
    return np.packbits(np.bincount(shingles % _U(bits), minlength=bits).astype(np.uint8) & 1).tobytes()


def _by_width(sketches: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each width in 64-bit words: the places of the sketches that have it, and their words, a row each."""
    widths = np.array([len(x) // 8 for x in sketches], np.int64)
    out = {}
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        out[w] = at, np.frombuffer(b"".join([sketches[i] for i in at]), np.uint64).reshape(len(at), w)
    return out


def _fold(sketches: np.ndarray, width: int) -> np.ndarray:
    """The sketches that the same sets have in ``width`` words."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _far(u: list[bytes], v: list[bytes]) -> np.ndarray:
    """Hamming distance of each pair of sketches, the wider one folded."""
    far = np.zeros(len(u), np.int64)
    for w, (at, x) in _by_width(u).items():
        for z, (own, y) in _by_width([v[i] for i in at]).items():
            narrow = min(w, z)
            far[at[own]] = np.bitwise_count(_fold(x[own], narrow) ^ _fold(y, narrow)).sum(1, dtype=np.int64)
    return far


def _may_link(far: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes, whose sketches differ in ``far`` bits, can reach the similarity."""
    return (far <= (100 - percent) * (x + y) // (100 + percent)) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, digest, sketch``: size, digest and parity sketch of the set; no digest without words."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ns, digests, small = [], [], []
        for text in each_text(b.column(1)):
            s = shingle_set(text, words)
            ns.append(len(s))
            digests.append(_digest(s) if len(s) else None)
            small.append(parity_sketch(s))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(small, pa.binary())], ["doc_id", "n_shingles", "digest", "sketch"])
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, n_shingles bigint, digest binary, sketch binary")


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def join_keys(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``key, id``: the join keys of each document, of equal sets in a task only those of the first; a null ``doc_id`` has none."""
    bands = Bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(__name__)
        seen = set()
        for b in batches:
            keys, ids, held = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), each_text(b.column(1))):
                s = shingle_set(text, words)
                if not len(s) or (own := _digest(s)) in seen:
                    continue
                seen.add(own)
                k = sketch_keys(s, bands)
                keys.append(k.view(np.int64)), ids.append(np.full(len(k), doc, np.int64))
                held += len(k)
                if held >= KEYS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], ["key", "id"])
                    keys, ids, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], ["key", "id"])
    return docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "key bigint, id bigint")


def verify(docs: DataFrame, found: DataFrame, pairs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a, b`` of documents whose sets reach the similarity: ``100 * shared >= percent * union``.

    Sizes and sketches rule most pairs out before the sets of the others are fetched.
    """
    def possible(b: pa.RecordBatch) -> pa.RecordBatch:
        x, y = b.column(2).to_numpy(), b.column(3).to_numpy()
        far = _far(b.column(4).to_pylist(), b.column(5).to_pylist())
        return b.select([0, 1]).filter(pa.array(_may_link(far, x, y, percent)))

    def sets(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, words).tobytes() for t in each_text(b.column(1))], pa.binary())], ["doc_id", "s"])

    def same(b: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * shared >= percent * (len(x) + len(y) - shared))
        return b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    side = lambda i, n, k: found.select(F.col("doc_id").alias(i), F.col("n_shingles").alias(n), F.col("sketch").alias(k))
    sketched = pairs.join(side("a", "_m", "_u"), "a").join(side("b", "_n", "_v"), "b").select("a", "b", "_m", "_n", "_u", "_v")
    near = keep(map_batches(sketched, possible, "a bigint, b bigint"))
    ids = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    held = map_batches(docs.select(F.col("doc_id").cast("bigint"), "text").join(ids, "doc_id", "left_semi"), sets, "doc_id bigint, s binary")
    both = (near.join(held.select(F.col("doc_id").alias("a"), F.col("s").alias("_x")), "a")
            .join(held.select(F.col("doc_id").alias("b"), F.col("s").alias("_y")), "b").select("a", "b", "_x", "_y"))
    return map_batches(both, same, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """``id, component``: the smallest id reachable over the links ``a, b``, for every id that has a link.

    Smallest labels spread over the links and then jump to the label of their label, until none changes.
    """
    edges = keep(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = keep(edges.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("_near"))
        spread = labels.join(near, "id").select("id", F.col("component").alias("_old"), F.least("component", "_near").alias("_new"))
        jump = labels.select(F.col("id").alias("_new"), F.col("component").alias("_far"))
        moved = keep(spread.join(jump, "_new", "left").select("id", "_old", F.least("_new", F.coalesce("_far", "_new")).alias("component")))
        changed = moved.filter("component <> _old").limit(1).count()
        labels = moved.select("id", "component")
        if not changed:
            return labels


def _groups(rows: DataFrame) -> DataFrame:
    """Rows ``key, id`` of keys that several documents hold, with the first and the preceding id of the group."""
    w = W.partitionBy("key").orderBy("id")
    seen = rows.select("key", "id", F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after"), F.first("id").over(w).alias("first"))
    return seen.filter(F.col("before").isNotNull() | F.col("after").isNotNull()).drop("after")


def _star_pairs(groups: DataFrame) -> DataFrame:
    """Each document of a group with the first of the group."""
    return groups.select(F.col("first").alias("a"), F.col("id").alias("b")).filter("a < b").distinct()


def _chain_pairs(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Each document of a group with the one before it, where their clusters differ."""
    pairs = groups.select(F.col("before").alias("a"), F.col("id").alias("b")).filter("a < b").distinct()
    side = lambda i: labels.select(F.col("id").alias(i), F.col("component").alias(f"_c{i}"))
    known = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return known.filter(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select("a", "b")


def _open(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows ``key, id, cluster, n`` of groups whose documents are not all in one cluster yet."""
    known = groups.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("cluster"))
    sizes = known.groupBy("key").agg(F.min("cluster").alias("_lo"), F.max("cluster").alias("_hi"), F.count("*").alias("n")).filter("_lo < _hi").select("key", "n")
    return known.join(sizes, "key")


def _cross_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of different clusters in a small group."""
    x, y = (rows.select("key", F.col("id").alias(i), F.col("cluster").alias(c)) for i, c in (("a", "_ca"), ("b", "_cb")))
    return x.join(y, "key").filter("a < b and _ca <> _cb").select("a", "b")


def _block_pairs(found: DataFrame, rows: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Pairs of different clusters in a large group whose sketches are near enough.

    A group is dealt over pairs of blocks, so a task never holds more than two blocks of it, and only pairs that the Hamming distance
    does not rule out leave the task.
    """
    def near(t):
        ids, cluster, size = (t.column(c).to_numpy() for c in ("id", "cluster", "size"))
        # Two widths in a group, seldom three: its sets are of one band or a little smaller.
        widths = _by_width(t.column("sketch").to_pylist())
        out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for w, (own, x) in widths.items():
            for z, (at, y) in widths.items():
                u, v = _fold(x, min(w, z)), _fold(y, min(w, z))
                for i, sketch in zip(own, u):
                    other = np.flatnonzero((ids[at] > ids[i]) & (cluster[at] != cluster[i]))
                    far = np.bitwise_count(v[other] ^ sketch).sum(1, dtype=np.int64)
                    other = at[other[_may_link(far, size[at[other]], size[i], percent)]]
                    out_a.append(np.full(len(other), ids[i])), out_b.append(ids[other])
        return pa.table({"a": np.concatenate(out_a).astype(np.int64), "b": np.concatenate(out_b).astype(np.int64)})

    held = found.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), "sketch")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    dealt = rows.withColumn("_blocks", blocks).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select("key", "id", "cluster", F.least("_own", "_other").alias("x"), F.greatest("_own", "_other").alias("y"))
    return dealt.join(held, "id").groupBy("key", "x", "y").applyInArrow(near, "a bigint, b bigint")


def class_links(docs: DataFrame, found: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Verified links ``a, b`` between class representatives that connect all that similarity connects."""
    firsts = found.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("_first"))
    shared = keep(_groups(join_keys(docs, words, percent)).select("key", "id"))
    # Of a class only the documents that made keys are named: one for each task at most.
    named = shared.select("id").distinct().join(found.select(F.col("doc_id").alias("id"), "digest"), "id").join(firsts, "digest").groupBy("id").agg(F.min("_first").alias("_first"))
    groups = keep(_groups(shared.join(named, "id").select("key", F.col("_first").alias("id")).distinct()))
    links = keep(verify(docs, found, keep(_star_pairs(groups)), words, percent))
    chains = keep(_chain_pairs(groups, components(links)))
    links = keep(links.unionByName(verify(docs, found, chains, words, percent)))
    still = keep(_open(groups, components(links)))
    pairs = _cross_pairs(still.filter(F.col("n") <= SMALL_GROUP)).unionByName(_block_pairs(found, still.filter(F.col("n") > SMALL_GROUP), percent, block))
    return links.unionByName(verify(docs, found, keep(pairs.distinct()), words, percent))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Add ``n_shingles`` and ``component_id`` (the smallest ``doc_id`` of its near-duplicate group) to every document.

    Texts with fewer than ``words`` words are one shingle; null texts and texts without words have none and are linked with nothing. Distinct ``doc_id``s are
    expected: rows that repeat one are one document and should have one text; a null ``doc_id`` gets nulls. Extra columns are carried along. Raises if a result column is already there.
    Shingles are equal when their 64-bit hashes are.
    """
    safe_columns(docs, ["n_shingles", "component_id"])
    found = keep(sketches(docs, words))
    labels = components(class_links(docs, found, words, percent, block))
    classes = found.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("_class"))
    named = classes.join(labels, classes["_class"] == labels["id"], "left").select("digest", F.coalesce("component", "_class").alias("_component"))
    placed = (found.filter(F.col("doc_id").isNotNull()).select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
              .groupBy(F.col("doc_id").alias("_id")).agg(F.max("n_shingles").alias("n_shingles"), F.min(F.coalesce("_component", "doc_id")).alias("component_id")))
    return docs.join(placed, F.col("doc_id").cast("bigint") == F.col("_id"), "left").drop("_id")
