"""The pipeline's stages with odd tables, and near duplicates and quality rules as the pipeline uses them, against brute force."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linespark.llm import parity_join, quality_rules

SMALL = "/root/testdata/sf0.001"


def components(texts, words, percent):
    """Smallest index reachable over links, by comparing all pairs."""
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])
    for a, b in combinations(range(len(texts)), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def near_copies(seed, n, lengths):
    rng = np.random.default_rng(seed)
    texts = [None, "", " \n", "one", "one", "one two three"]
    while len(texts) < n:
        base = [f"w{i}" for i in rng.integers(0, 400, int(rng.choice(lengths)))]
        for _ in range(int(rng.integers(1, 9))):
            words = list(base)
            for at in rng.choice(len(words), int(rng.integers(0, max(2, len(words) // 12))), replace=False):
                words[at] = f"x{int(rng.integers(0, 1000))}"
            texts.append(" ".join(words[int(rng.integers(0, 2)):]))
    return texts


@pytest.mark.parametrize("words,percent,block", [(5, 80, 2048), (4, 85, 2), (5, 80, 3)])
def test_near_duplicates_of_short_and_long_texts(spark, words, percent, block):
    texts = near_copies(words * percent + block, 240, [6, 8, 10, 14, 15, 22, 40, 200])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.near_duplicates(docs, words, percent, block).collect()}
    assert got == components(texts, words, percent)


def test_large_open_group_is_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "_star_pairs", lambda groups: groups.select(F.col("first").alias("a"), F.col("id").alias("b")).limit(0))
    monkeypatch.setattr(parity_join, "_chain_pairs", lambda groups, labels: groups.select(F.col("first").alias("a"), F.col("id").alias("b")).limit(0))
    texts = near_copies(11, 150, [60])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for small, block in ((0, 7), (1000, 7)):
        monkeypatch.setattr(parity_join, "SMALL_GROUP", small)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.near_duplicates(docs, 5, 80, block).collect()}
        assert got == components(texts, 5, 80)


def test_copies_over_many_tasks(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("a b c d e f g h i j k l")).otherwise(
        F.concat_ws(" ", F.lit("z"), *[F.md5(F.concat("id", F.lit(str(i)))) for i in range(9)])).alias("text")).repartition(16)
    got = {r["doc_id"]: r["component_id"] for r in parity_join.near_duplicates(docs, 5, 80).collect()}
    assert got == {i: 0 if i % 3 == 0 else i for i in range(2000)}
    made = parity_join.join_keys(docs, 5, 80).filter("id % 3 = 0").select("id").distinct().count()
    assert made <= 16


def test_strangers_do_not_share_keys():
    rng = np.random.default_rng(2)
    for percent, n in ((80, 11), (80, 12), (80, 13), (80, 5), (85, 9), (80, 60)):
        bands = parity_join.Bands(percent)
        keys = np.concatenate([np.unique(parity_join.sketch_keys(np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)), bands)) for _ in range(4000)])
        assert np.unique(keys, return_counts=True)[1].max() <= 2


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "river stone house yellow window market garden winter summer paper silver mountain forest letter".split()


def made(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, ". ".join(" ".join(rng.choice(WORDS, 9)) for _ in range(14)), "en", f"s{i % 3}", 1) for i in range(n)]


def test_judging_beside_the_text(spark, monkeypatch):
    rows = made(200) + [(500 + i, "# $ % & * " * 40 + " ".join(WORDS) * 3, "en", "s0", 1) for i in range(9)] + [(900, None, None, None, None), (901, "short", "en", None, 1), (900, rows_text(3), None, None, 2)]
    docs = spark.createDataFrame(rows, DOCS)
    plain = {(r["doc_id"], r["n_words"]): (r["kept"], r["base_failed"]) for r in quality_rules.judge(docs).collect()}
    for few in (10_000, 0):
        monkeypatch.setattr(quality_rules, "FEW_GROUPS", few)
        beside = quality_rules.judge(docs, carry_text=True)
        assert {(r["doc_id"], r["n_words"]): (r["kept"], r["base_failed"]) for r in beside.collect()} == plain
        assert sorted(r["text"] or "" for r in beside.collect()) == sorted(r[1] or "" for r in rows)
    assert not any(plain[500 + i, n][0] for i in range(9) for d, n in plain if d == 500 + i)


def rows_text(i):
    return made(i + 1, 7)[i][1]


def test_no_text_is_dealt_by_language_and_source(spark):
    docs = spark.createDataFrame(made(120), DOCS)
    plan = corpus_pipeline.apply_quality_rules(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_stages_with_odd_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    prose = docs.filter("lang = 'en' and n_chars between 1500 and 4000").orderBy("doc_id").first()["text"]
    odd = spark.createDataFrame([(None, None, None, None, None), (None, prose, "en", None, 1), (None, prose, "en", None, 1), (3, "", "de", "s", 0), (5, prose, None, "x", 2),
                                 (5, prose, None, "x", 2)], DOCS).select(docs.columns)
    extra = docs.unionByName(odd).withColumns({c: F.lit("x") for c in ("key", "id", "_first", "_salt", "part", "component", "length")})
    for table in (extra, extra.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = corpus_pipeline.keep(stage(spark, now, SMALL))
            assert now.columns == table.columns, name
        packed = corpus_pipeline.STAGES[-1][1](spark, now, SMALL)
        tokens = packed.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()
        if table is extra:
            # Rows without an id are nobody's copies: both stay.
            assert now.filter("doc_id is null").count() == 2 and len(tokens) > 50
            assert all(r["n"] % r["doc_tokens"] == 0 for r in tokens)
        else:
            assert not tokens
