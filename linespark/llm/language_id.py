"""Language identification in two levels: the language family first, then one-versus-one linear SVMs inside the family.

A text becomes one vector of hashed byte n-grams (1 to 3 bytes, letters lower-cased, everything else a blank), with square
roots of the shares of the whole text, so its length does not matter.  Both levels are one-versus-one linear support
vector machines (squared hinge loss): between the mean-balanced samples of families, and between the languages of one
family.  The winner of a level has the most pair votes, ties by the larger sum of margins.

A vote always has a winner, also for a text in a language that was never learned, for code and for random letters.  So
every text is also held against what each learned language is like (:class:`Typical`); one that is like none of them gets
a score below ``REJECT``, whatever the votes say.

Fitting uses a bounded sample: at most ``sample_rows`` labelled documents, shared out equally among the languages and chosen
by a hash of the id.  Every document is predicted from its whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import each_text, map_batches, safe_columns, worker_cache

#: Families of ISO 639-1 codes; a language that is not listed is a family of its own.
FAMILIES = {"romance": "fr es it pt ro ca gl oc", "germanic": "en de nl sv da no nb nn is af fy lb", "slavic": "ru uk be pl cs sk bg sr hr sl mk",
            "uralic": "fi et hu", "turkic": "tr az kk uz", "indic": "hi bn mr ur pa gu ne", "semitic": "ar he am mt"}
DIM = 4096
SAMPLE_ROWS = 2400
#: Rows of the sample that are widened to doubles at once.
FIT_ROWS = 128
#: A text that is like no learned language scores less than this; two levels of one pair each never do on their own.
REJECT = 0.25
#: Mean log likelihood (nats per n-gram) that a text may fall short of its language's usual level, more by ``SLACK`` over its
#: bytes when it is short, and by ``TRUST`` times the lead over the next language; ``ALONE`` is the lead where there is no other.
SHORTFALL, SLACK, TRUST, ALONE = 0.8, 50.0, 2.0, 0.5
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_BLANK = bytes(b if _LETTER[b] else 0x20 for b in range(256))


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), lang)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str, dim: int = DIM) -> np.ndarray:
    """Unit vector of hashed byte n-grams of the whole text; zero when nothing is left."""
    b = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(_BLANK).split()) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(dim, np.float32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(263) + b[2:]
    counts = np.zeros(dim)
    for order, grams in ((1, b), (2, two), (3, three)):
        counts += np.bincount(((grams + np.uint32(order)) * np.uint32(2654435761) >> np.uint32(16)) % dim, minlength=dim)
    v = np.sqrt(counts)
    return (v / np.linalg.norm(v)).astype(np.float32)


def _blocks(n: int) -> Iterator[slice]:
    return (slice(i, i + FIT_ROWS) for i in range(0, n, FIT_ROWS))


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 150) -> np.ndarray:
    """Weights, the bias last, of a squared-hinge SVM by accelerated gradient steps; both classes weigh the same.

    The rows are widened to doubles a block at a time, as the driver holds them beside its other work.
    """
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost
    w = z = np.zeros(x.shape[1] + 1)
    longest = max(float(np.square(x[b]).sum(1).max()) for b in _blocks(len(x))) + 1
    step, before = 1 / (1e-3 + 2 * cost * longest), 1.0
    for _ in range(rounds):
        pull = np.zeros_like(z)
        for b in _blocks(len(x)):
            rows = x[b].astype(float)
            slack = share[b] * y[b] * np.maximum(0, 1 - y[b] * (rows @ z[:-1] + z[-1]))
            pull[:-1] += rows.T @ slack
            pull[-1] += slack.sum()
        new = z - step * (1e-3 * z - 2 * pull)
        after = (1 + (1 + 4 * before * before) ** 0.5) / 2
        z, w, before = new + (before - 1) / after * (new - w), new, after
    return w


@dataclass
class Vote:
    """One level: classes and a weight vector for each pair (first wins where the margin is positive)."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Vote:
        classes = sorted(set(labels.tolist()))
        pairs = list(combinations(range(len(classes)), 2))
        weights = []
        for a, b in pairs:
            rows = np.isin(labels, [classes[a], classes[b]])
            weights.append(fit_svm(x if rows.all() else x[rows], np.where(labels[rows] == classes[a], 1.0, -1.0)))
        return cls(classes, pairs, np.array(weights).reshape(len(pairs), x.shape[1] + 1))

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        """The winner and a score: the least logistic value of its own pair margins (1 where there is no other class)."""
        if not self.pairs:
            return self.classes[0], 1.0
        margins = self.weights[:, :-1] @ v + self.weights[:, -1]
        votes, sums, least = np.zeros(len(self.classes)), np.zeros(len(self.classes)), np.full(len(self.classes), np.inf)
        for (a, b), m in zip(self.pairs, margins):
            for c, s in ((a, m), (b, -m)):
                votes[c] += s > 0
                sums[c] += s
                least[c] = min(least[c], s)
        best = max(range(len(votes)), key=lambda c: (votes[c], sums[c], -c))
        return self.classes[best], float(1 / (1 + np.exp(-3 * least[best])))


@dataclass
class Typical:
    """What each language is like: log shares of its n-grams, and the usual mean log likelihood of a text of it.

    The level is the median over sample texts, each judged by shares of the other half of the sample, so it is as low as
    unseen texts' when the sample is small. A language with a single text has none and turns nothing away.
    """

    shares: np.ndarray
    levels: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Typical:
        def logs(v: np.ndarray) -> np.ndarray:
            return np.log((np.square(v, dtype=float).mean(0) + 1e-6) / (1 + 1e-6 * v.shape[1]))
        shares, levels = [], []
        for lang in sorted(set(labels.tolist())):
            own = x[labels == lang]
            halves = [own[::2], own[1::2]]
            shares.append(logs(own))
            levels.append(np.median(np.concatenate([np.square(a, dtype=float) @ logs(b) for a, b in (halves, halves[::-1])])) if len(own) > 1 else -np.inf)
        return cls(np.array(shares), np.array(levels))

    def excess(self, v: np.ndarray, n_bytes: int) -> float:
        """By how much a text is less like its likeliest language than allowed; up to 0 for one that is like it."""
        likely = self.shares @ np.square(v, dtype=float)
        best = int(likely.argmax())
        lead = likely[best] - np.delete(likely, best).max() if len(likely) > 1 else ALONE
        return float(self.levels[best] - likely[best] - TRUST * lead - SHORTFALL - SLACK / max(1, n_bytes))


@dataclass
class Model:
    families: Vote
    languages: dict[str, Vote]
    typical: Typical

    def predict(self, text: str | None) -> tuple[str, float]:
        """``und`` and 0 for a null text or one without a letter; a score below ``REJECT`` for one that is like no learned language."""
        if not text or not has_letter(text):
            return "und", 0.0
        v = features(text)
        family, a = self.families.predict(v)
        lang, b = self.languages[family].predict(v)
        excess = self.typical.excess(v, len(text.encode()))
        return lang, a * b if excess <= 0 else a * b * REJECT * float(np.exp(-excess))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on rows with ``doc_id, text`` and non-null ``lang``; None when no text with a letter is labelled."""
    ids = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    n = max(1, ids.select("lang").distinct().limit(sample_rows + 1).count())
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= max(1, sample_rows // n)).select("doc_id").distinct().limit(sample_rows)
    texts = labelled.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")  # at most `sample_rows` ids

    def vectors(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(lang, zlib.compress(features(text).tobytes(), 1)) for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if has_letter(text)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "v"])
    sample = map_batches(texts.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()), vectors, "lang string, v binary").collect()  # bounded, as the ids are
    if not sample:
        return None
    langs = np.array([r["lang"] for r in sample], object)
    x = np.empty((len(sample), DIM), np.float32)
    for i, r in enumerate(sample):
        x[i] = np.frombuffer(zlib.decompress(r["v"]), np.float32)
    del sample
    for lang in sorted(set(langs.tolist())):  # in order of language and bytes, so that the fit does not follow the order of the rows
        own = np.flatnonzero(langs == lang)
        x[own] = x[own[sorted(range(len(own)), key=lambda i: x[own[i]].tobytes())]]
    order = np.argsort(langs, kind="stable")
    x, langs = x[order], langs[order]
    families = np.array([family_of(x) for x in langs], object)
    return Model(Vote.fit(x, families), {f: Vote.fit(x[families == f], langs[families == f]) for f in sorted(set(families))}, Typical.fit(x, langs))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) from ``text`` alone.

    Null texts and texts without a letter, and all texts when there is no model, get ``und`` and 0. Other columns are carried along as they are; repeated rows
    get the same answer. Raises if a result column is already there.
    """
    safe_columns(docs, ["lang_pred", "score"])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        worker_cache(__name__)
        found = [model.predict(t.decode()) if model else ("und", 0.0) for t in each_text(b.column("text"))]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                          [*b.schema.names, "lang_pred", "score"])
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return map_batches(docs, run, schema)
