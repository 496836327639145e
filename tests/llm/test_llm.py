"""The training-data operators against brute force, SQL, round trips and held-out rows, with odd inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linespark.llm import (language_id, line_dedup, lm_scoring, multiprobe_lsh, packing, parity_join, queries, quality_rules, sentence_pieces, url_lists,
                           word_piece_counts)
from linespark.llm.common import word_hashes
from tests.compare import compare, connect

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LINE = "a line that is long enough to count"
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n\x0b ", "en", "s", 5), (4, f"{LINE}\nshort\n{LINE}", "en", "s", 1), (5, f"  {LINE.upper()}\t\nother", None, "s", 1),
       (6, f"x\n{LINE}", "en", None, 1), (7, "word " * 30_000, "en", "s", 1), (8, "été ▁ 日本 \x00 <|endoftext|> it's", "fr", "s", 1),
       (9, "one two three four five six seven eight nine ten eleven twelve", "en", "s", 1), (10, "ONE two three four five six seven eight nine ten eleven twelve", "en", "s", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("_d", F.lit(7)).withColumn("key", F.lit("k"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, con, name):
    assert compare(queries.QUERIES[name](spark, SMALL), con, queries.SQL[name]) is None


MODEL = queries.tokenizer_path("piece_bpe_32k.model")
TOKENIZER = queries.tokenizer_path("word_bpe_49k.json")
RUNS = {
    "op1": lambda d: lm_scoring.score_documents(d), "op2": lambda d: sentence_pieces.encode(d, MODEL), "op5": lambda d: packing.pack_documents(d, TOKENIZER),
    "op4": lambda d: language_id.predict(d, language_id.fit(d)), "op6": lambda d: word_piece_counts.count_pieces(d, MODEL), "op8": lambda d: quality_rules.judge(d, min_group=2),
    "op9": lambda d: line_dedup.dedup_lines(d), "op10": lambda d: parity_join.near_duplicates(d)}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_rows_and_empty_tables(odd, empty, name):
    rows = RUNS[name](odd).collect()
    assert {r["doc_id"] for r in rows} == set(range(1, 11))
    assert name == "op5" or len(rows) == 10
    assert RUNS[name](empty).count() == 0
    assert len(RUNS[name](odd.unionByName(odd)).collect()) >= 20


@pytest.mark.parametrize("name,column", [("op1", "n_words"), ("op2", "piece_ids"), ("op4", "score"), ("op6", "n_pieces"), ("op8", "kept"), ("op9", "n_lines"), ("op10", "component_id")])
def test_clashing_result_column(odd, name, column):
    with pytest.raises(ValueError, match=column):
        RUNS[name](odd.withColumn(column, F.lit(1)))


def test_word_hashes():
    a, b = word_hashes(b" the cat\n the\tdog "), word_hashes(b"dog the")
    assert len(a) == 4 and a[0] == a[2] == b[1] and a[3] == b[0] and len(set(a.tolist())) == 3
    assert len(word_hashes(b" \n")) == 0
    words = [b"w" * (i % 50 + 1) + b"%d" % i for i in range(40_000)] + [b"x" * 700_000]
    assert word_hashes(b" ".join(words)).tolist() == [word_hashes(w)[0] for w in words]


def test_lm_scores_leave_the_document_out(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "q q q q")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(d).collect()}
    assert got[1]["log_score"] == pytest.approx(np.log(1 / 2) + np.log(1 / 1))  # c(start a)=1 of 2 other starts, c(a b)=1 of 1
    assert got[3]["mean_score"] == pytest.approx(np.log(0.4 * 4 / 8))


def test_lm_scores_do_not_depend_on_chunks_and_parts(odd):
    texts = odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10))
    rows = lambda **sizes: {r["doc_id"]: (r["n_words"], r["log_score"]) for r in lm_scoring.score_documents(texts, **sizes).collect()}
    whole, cut = rows(), rows(chunk_words=5, part_grams=3)
    assert whole.keys() == cut.keys() and all(whole[k][0] == cut[k][0] and whole[k][1] == pytest.approx(cut[k][1]) for k in whole)


def best_score(text: str, scores: dict[str, float], unknown: float) -> float:
    best = [0.0] + [-np.inf] * len(text)
    for i in range(len(text)):
        alone = False
        for j in range(i + 1, min(len(text), i + 20) + 1):
            if text[i:j] in scores:
                alone = alone or j == i + 1
                best[j] = max(best[j], best[i] + scores[text[i:j]])
        if not alone:
            best[i + 1] = max(best[i + 1], best[i] + unknown)
    return best[-1]


def test_sentence_pieces(spark):
    p = sentence_pieces.Pieces.load(MODEL)
    byte_ids = set(p.byte_ids.values())
    scores = {v.decode(): p.scores[i] for i, v in p.out.items() if i not in byte_ids}
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").filter("text is not null").limit(40).collect()]
    for chunk in {c for t in texts for c in p.chunk.findall(b" " + t.encode())}:
        ids = p.segment(chunk)
        if not byte_ids & set(ids):
            assert sum(p.scores[i] for i in ids) == pytest.approx(best_score(chunk.decode(), scores, p.unknown))
    for t in [*texts, "", " ", "  a  b ", "a▁b ▁", "\n\n", "日本語 😀", "x" * 5000]:
        assert p.decode(p.encode(t.encode())).decode() == t
    d = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id bigint, text string")
    back = sentence_pieces.decode(sentence_pieces.encode(d, MODEL), MODEL).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {i: t or "" for i, t in enumerate([*texts, None])}


def test_word_pieces():
    pieces = word_piece_counts.pieces_of(MODEL)
    a, known = word_piece_counts.Automaton(pieces), {p.decode() for p in pieces}

    def greedy(word: str) -> int:
        s, i, n = "▁" + word, 0, 0
        while i < len(s):
            j = next((j for j in range(min(len(s), i + 50), i, -1) if s[i:j] in known and s[i:j].startswith("▁") == (i == 0)), 0)
            if not j:
                return -1
            i, n = j, n + 1
        return n
    words = ["", "the", "unbelievable", "Antidisestablishmentarianism", "été", "日本語", "▁", "x😀y", "aaaaaaaaaaaaaaaaaaaaaaa", "tion,ing.", "\x00"]
    assert [a[w.encode()] for w in words] == [greedy(w) for w in words]


def test_packing(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(TOKENIZER)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(ODD, DOCS).selectExpr("-doc_id as doc_id", "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = packing.pack_documents(docs, TOKENIZER).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        ids = array("I", [*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 1])
        own.sort(key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in own) == ids.tobytes() and all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(r["ids"]) for r in own)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert 1 - total / (2048 * len(sequences)) < 0.03


@pytest.mark.parametrize("histogram", [{}, {5: 3}, {2048: 7, 1: 5000, 1000: 3}, {1025: 4, 1024: 5, 1023: 9}])
def test_pack_plan_places_every_piece_once(histogram):
    placed = Counter()
    for packs, content in packing.plan_packs(histogram):
        assert sum(length * n for length, n in content) <= 2048
        for length, n in content:
            placed[length] += packs * n
    assert placed == Counter(histogram)


def test_line_dedup_is_reversible(spark):
    d = spark.createDataFrame([(i, f"{LINE} {i % 2}\nown line of document number {i}") for i in range(8)], "doc_id bigint, text string")
    before = line_dedup.references(d.filter("doc_id < 5"))
    after = line_dedup.insert(before, d)
    assert line_dedup.insert(after, d).count() == after.count() == 16
    back = line_dedup.delete(after, d.filter("doc_id >= 5").select("doc_id"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, before.collect()))
    old, new = line_dedup.counts(before), line_dedup.counts(after)
    added, removed = new.join(old, "key", "left_anti"), old.join(new, "key", "left_anti")
    filters = line_dedup.update_filters(line_dedup.build_filters(old, 4), added, removed, 4)
    passed = {bytes(r["key"]) for r in line_dedup.screen(after, filters, 4).collect()}
    assert {bytes(r["key"]) for r in new.collect()} <= passed
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(d.filter("doc_id < 2"), state=after).collect()}
    assert got == {i: f"own line of document number {i}" for i in range(2)}


def test_asked_keys_of_a_shard_are_cut_into_parts(spark, monkeypatch):
    assert line_dedup.asking_parts(100_000_000, 16) == 32 and line_dedup.asking_parts(0, 16) == 1
    monkeypatch.setattr(line_dedup, "ASKED_PER_PART", 50)
    monkeypatch.setattr(line_dedup, "SLICE", 7)
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(1000)]
    table = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    passed = line_dedup.screen(table, line_dedup.build_filters(table.limit(300), 2), 2)
    got = {bytes(r["key"]) for r in passed.collect()}
    assert {bytes(r["key"]) for r in table.limit(300).collect()} <= got and len(got) < 310


def test_filters_grow_with_their_shards(spark):
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(4000)]
    table = lambda ks: spark.createDataFrame([(bytearray(k),) for k in ks], "key binary")
    filters = line_dedup.build_filters(table(keys[:400]), 2)
    for n in (1200, 4000):
        filters = line_dedup.update_filters(filters, table(keys[n // 3:n] if n == 1200 else keys[1200:]), table([]), 2, table(keys[:n]))
    found = [line_dedup.CuckooFilter.from_bytes(bytes(r["filter"])) for r in filters.collect()]
    assert len(found) == 2 and all(f.slots.size >= 1900 and len(f.overflow) < 20 for f in found) and all(any(k in f for f in found) for k in keys)


def test_repeated_and_null_ids(spark):
    other = "another line that is long enough to count"
    rows = [(1, f"{LINE}\nx", "en", "s", 1), (1, f"x\n{LINE}\n{other}", "en", "s", 1), (2, f"{LINE}\n{other}", "en", "s", 1), (None, f"{LINE}\nnull", "en", "s", 1)]
    texts = lambda rows: sorted(r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(rows, DOCS), "").collect())
    assert texts(rows) == sorted(r[1] for r in rows)  # two documents hold the line
    assert texts([*rows, (3, LINE, "en", "s", 1)]) == sorted(["x", f"x\n{other}", other, f"{LINE}\nnull", LINE])
    good, bad = " ".join(f"word{i}" for i in range(80)), "too short"
    docs = spark.createDataFrame([(1, good, "en", "s", 1), (1, bad, "en", "s", 1), (None, good, "en", "s", 1), (None, bad, "en", "s", 1)], DOCS)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.apply_quality_rules(spark, docs, "").collect()) == [(0, good), (1, good)]


def test_cuckoo_filter():
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(6000)]
    f = line_dedup.CuckooFilter.of(keys[:3000])
    assert all(k in f for k in keys[:3000]) and sum(k in f for k in keys[3000:]) < 30
    for k in keys[:1500]:
        f.discard(k)
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert all(k in f for k in keys[1500:3000]) and sum(k in f for k in keys[:1500]) < 30
    tight = line_dedup.CuckooFilter(1)
    for k in keys[:100]:
        tight.add(k)
    assert all(k in tight for k in keys[:100])


def test_parity_sketches_find_every_link():
    rng = np.random.default_rng(3)
    for percent in (80, 85):
        bands = parity_join.Bands(percent)
        for n in [6, 7, 8, 9, 12, 20, 40, 100, 400, 1500]:
            for _ in range(20):
                a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                gone = int(rng.integers(0, n * (100 - percent) // 100 + 1))
                b = a[gone:]
                while True:  # as many new ones as the similarity allows
                    c = np.unique(np.concatenate([b, rng.integers(0, 2**64, 1, dtype=np.uint64)]))
                    if 100 * len(a[gone:]) < percent * (len(a) + len(c) - len(a[gone:])):
                        break
                    b = c
                if 100 * len(a[gone:]) >= percent * (len(a) + len(b) - len(a[gone:])) and len(a) != len(b) or gone:
                    keys = [set(parity_join.sketch_keys(s, bands).tolist()) for s in (a, b)]
                    if 100 * (n - gone) >= percent * (n + len(b) - (n - gone)):
                        assert keys[0] & keys[1]


def test_near_duplicate_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "SMALL_GROUP", 2)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    texts = []
    for i in range(60):
        words = list(base)
        for at in rng.choice(len(words), int(rng.integers(0, 5)), replace=False):
            words[at] = f"x{i}{at}"
        texts.append(" ".join(words))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [{tuple(t.split()[i:i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    root = list(range(60))

    def find(x):
        return x if root[x] == x else find(root[x])
    for a, b in combinations(range(60), 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = parity_join.near_duplicates(d).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), find(i)) for i in range(60)}


def test_quality_statistics_and_outliers(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(spark.createDataFrame(ODD, DOCS).withColumn("doc_id", -F.col("doc_id")), allowMissingColumns=True)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in quality_rules.text_stats(docs).collect():
        t = texts[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        g = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        c = Counter(g)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len({i + k for i, x in enumerate(g) if c[x] > 1 for k in range(3)}))
    rng = np.random.default_rng(1)
    plain = [(i, " ".join("".join(rng.choice(list("abcdefg"), rng.integers(2, 9))) for _ in range(80)), "en", "s") for i in range(300)]
    junk = [(1000 + i, " ".join(f"###{j}$$$%%%" for j in rng.integers(0, 10**6, 80)), "en", "s") for i in range(40)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(plain + junk, "doc_id bigint, text string, lang string, source string"), min_group=50).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(40))


def made_texts(n: int, n_junk: int, at: int = 0, source: str = "s", seed: int = 2) -> list[tuple]:
    """Plain texts from id ``at``, symbol junk from id ``at`` + 10,000."""
    rng = np.random.default_rng(seed)
    plain = [(at + i, " ".join("".join(rng.choice(list("abcdefg"), rng.integers(2, 9))) for _ in range(80)), "en", source) for i in range(n)]
    return plain + [(at + 10_000 + i, " ".join(f"###{j}$$$%%%" for j in rng.integers(0, 10**6, 80)), "en", source) for i in range(n_junk)]


QUALITY = "doc_id bigint, text string, lang string, source string"


@pytest.mark.parametrize("n_junk,n", [(105, 195), (135, 165)])
def test_quality_of_a_group_with_much_junk(spark, n_junk, n):
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(made_texts(n, n_junk), QUALITY)).collect()}
    assert all(got[i] for i in range(n)) and not any(got[10_000 + i] for i in range(n_junk))


def test_quality_of_a_group_of_copies(spark):
    rows = made_texts(60, 20) + [(20_000 + i, made_texts(1, 0)[0][1], "en", "s") for i in range(120)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, QUALITY)).collect()}
    assert all(k == (not 10_000 <= i < 20_000) for i, k in got.items())


def test_quality_of_small_tables_and_groups(spark):
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(made_texts(24, 6), QUALITY)).collect()}
    assert all(k == (i < 10_000) for i, k in got.items())
    rows = made_texts(52, 8) + made_texts(300, 0, 30_000, "t")  # the junk of a group of 60 is judged by the group
    stats = quality_rules.keep(quality_rules.text_stats(spark.createDataFrame(rows, QUALITY)).withColumn("base_failed", quality_rules.base_failed()))
    got = {r["doc_id"]: r["kept"] for r in quality_rules.verdicts(stats).collect()}
    assert all(k == (not 10_000 <= i < 20_000) for i, k in got.items()) and len(got) == 360


def test_quality_joins_deal_a_group_over_salts(spark):
    stats = quality_rules.keep(quality_rules._with_salt(spark.range(0, 6400, 1, 4)))
    assert stats.groupBy("_salt").count().agg(F.max("count")).first()[0] <= 100 and quality_rules.SALTS >= 16
    assert quality_rules._salted(spark.range(3)).groupBy("id").agg(F.countDistinct("_salt").alias("n")).filter(F.col("n") == quality_rules.SALTS).count() == 3


def test_language_held_out(spark):
    rows = queries.op4(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_texts_without_letters(odd):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in RUNS["op4"](odd).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[9][0] in ("en", "fr")


STRANGE = ["Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. Quanto a dir qual era è cosa dura questa selva selvaggia e aspra e forte",
           "Litwo ojczyzno moja ty jesteś jak zdrowie ile cię trzeba cenić ten tylko się dowie kto cię stracił dziś piękność twą w całej ozdobie widzę i opisuję bo tęsknię po tobie",
           "Мой дядя самых честных правил, когда не в шутку занемог, он уважать себя заставил и лучше выдумать не мог.", "国境の長いトンネルを抜けると雪国であった。夜の底が白くなった。信号所に汽車が止まった。",
           "for (int i = 0; i < n; ++i) { if (arr[i] == nullptr) continue; size_t len = strlen(arr[i]); memcpy(buf + off, arr[i], len); off += len; } return std::make_pair(buf, off);",
           "qzxv jkwp vvqk xzzj pqkw wjxv kkzq xqvj zpwk jxqz vwkp qjzx kvxw pzqj xkvw qzpj wxkv jzqp kxwv zqjp " * 3]


def test_language_stage_turns_strange_texts_away(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1 - i, t, None, "s", len(t)) for i, t in enumerate(STRANGE)], DOCS).select(docs.columns)
    left = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(odd), "").select("doc_id").collect()}
    assert not {-1 - i for i in range(len(STRANGE))} & left
    clean = {r["doc_id"] for r in docs.filter("lang is not null and n_chars >= 200").collect()}
    assert len(clean - left) <= 0.002 * len(clean)


def test_nearest_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op7(spark, sf).collect()
    table = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    hit = total = 0
    vectors = dict(table)
    by_query = defaultdict(dict)
    for r in rows:
        by_query[r["query_id"]][r["rank"]] = r
    for q, v in table:
        if q % 20 == 0:
            true = sorted(((-float(v @ x), i) for i, x in table if i != q))[:20]
            assert sorted(by_query[q]) == list(range(1, 21))
            found = [by_query[q][k] for k in range(1, 21)]
            assert [r["score"] for r in found] == pytest.approx([float(v @ vectors[r["vec_id"]]) for r in found], rel=1e-12, abs=1e-12)
            assert [r["vec_id"] for r in found] == [i for _, i in sorted((-r["score"], r["vec_id"]) for r in found)] and q not in {r["vec_id"] for r in found}
            # What was found of the true nearest stands in their order.
            nearest = [i for _, i in true]
            places = [nearest.index(r["vec_id"]) for r in found if r["vec_id"] in nearest]
            assert places == sorted(places)
            hit += len({i for _, i in true} & {r["vec_id"] for r in by_query[q].values()})
            total += 20
    assert hit >= 0.9 * total


def test_nearest_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [-1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (40, [0.0, 0.0]), (9, [1.0])]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit("x"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in multiprobe_lsh.nearest(d, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 1.0), (0, 3, 2, 0.5), (0, 4, 3, -1.0), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 0.5), (20, 4, 3, -1.0)]
    assert multiprobe_lsh.nearest(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_url_lists_as_of(spark):
    entries = spark.createDataFrame([("l", "bad.com", "2024-01-10", "add"), ("l", "bad.com", "2024-01-10", "add"), ("l", "bad.com", "2024-02-10", "remove"), ("l", "bad.com", "2024-03-01", "add"),
                                     ("m", "x.org/a/b", "2023-01-01", "add"), ("m", None, "2023-01-01", "add"), ("m", "y.org", None, "add"), ("m", "z.org", "2024-01-01", "odd")],
                                    "list_id string, pattern string, day string, action string")
    asked = [(1, "http://www.Bad.com/p?q#f", "2024-01-09"), (2, "http://www.Bad.com/p", "2024-01-10"), (3, "https://bad.com:80/", "2024-02-10"), (4, "bad.com", "2025-06-01"), (5, "http://notbad.com/", "2024-01-20"),
             (6, "http://x.org/a/b/c", "2024-01-01"), (7, "http://x.org/a/bc", "2024-01-01"), (8, None, "2024-01-20"), (9, "", "2024-01-20"), (10, "http://bad.com", None)]
    d = spark.createDataFrame(asked, "capture_id bigint, url string, fetched string").withColumn("n", F.lit(1))
    got = {r["capture_id"]: (r["blocked"], r["n_entries"], r["pattern"]) for r in url_lists.filter_urls(d, entries).collect()}
    no = (False, 0, None)
    assert got == {1: no, 2: (True, 1, "bad.com"), 3: no, 4: (True, 1, "bad.com"), 5: no, 6: (True, 1, "x.org/a/b"), 7: no, 8: no, 9: no, 10: no}
    assert url_lists.filter_urls(d, entries.limit(0)).filter("blocked").count() == 0 and url_lists.filter_urls(d.limit(0), entries).count() == 0


def test_url_lists_with_capitals_in_the_path(spark):
    entries = spark.createDataFrame([("l", "News.org/A/Story", "2024-01-01", "add")], "list_id string, pattern string, day string, action string")
    d = spark.createDataFrame([(1, "http://NEWS.org/A/Story/2", "2024-02-01"), (2, "http://news.org/a/story", "2024-02-01")], "capture_id bigint, url string, fetched string")
    got = {r["capture_id"]: (r["blocked"], r["pattern"]) for r in url_lists.filter_urls(d, entries).collect()}
    assert got == {1: (True, "news.org/A/Story"), 2: (False, None)}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.keep(stage(spark, docs, SMALL))
        assert out.columns == docs.columns
        docs = out
        n.append(docs.count())
    assert n == sorted(n, reverse=True) and n[-1] > 0.5 * n[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == n[-1]
