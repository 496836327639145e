"""Importance resampling, conversation repair and sharding against brute force, with odd inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from linespark.llm import conversation_repair as repair, importance_resampling as resampling, queries, sharding

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, rank string, _at int, part int"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "Aa aA ÉÉ éé 日本 x9-y_z #7"), (None, "the a " * 30), (6, "the of and " * 40_000), (7, "a " * 19), (7, "the of " * 10), (7, "the of " * 10)]


# -- importance resampling -----------------------------------------------------------------------------------------

def features(text, run=1):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    return w, [" ".join(w[i:i + n]) for n in range(1, run + 1) for i in range(len(w) - n + 1)]


def brute_resample(docs, target, run=1, percent=10, min_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in features(x, run)[1]) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out = []
    for doc, text in docs:
        w, f = features(text, run)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w)])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = i + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("run,percent", [(1, 10), (1, 60), (3, 100), (2, 0)])
def test_resample_odd_rows(spark, run, percent):
    docs = spark.createDataFrame([(d, x, "r", 5, 6) for d, x in ODD], DOCS)
    target = ["the of and", None, "日本 a"]
    out = resampling.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), percent, run)
    assert {"doc_id", "part", "n_words", "n_features", "weight", "score", "rank"} <= set(out.columns)
    got = Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in out.collect())
    assert got == brute_resample(ODD, target, run, percent)


def test_resample_small_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("text").collect()]
    got = Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in queries.QUERIES["op11_bit_sliced_resampling"](spark, SMALL).collect())
    assert got == brute_resample(docs, target)


def test_resample_empty_tables_and_text(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(d, x, "r", 5, 6) for d, x in ODD], DOCS)
    assert resampling.resample(none, some).count() == 0
    assert resampling.resample(some, none).filter("weight is null").count() == 0
    kept = resampling.resample(some, some, percent=50, carry_text=True)
    assert "text" in kept.columns and {r["text"] for r in kept.collect()} == {x for _, x in ODD}


def test_bit_sliced_sums_are_exact():
    rng = np.random.default_rng(1)
    gains = rng.integers(-20_000, 20_000, resampling.BUCKETS)
    counts = [rng.integers(0, 2**k, resampling.BUCKETS) for k in (0, 1, 3, 20)]
    assert resampling.weighted_sums([resampling.bit_planes(c) for c in counts], gains).tolist() == [int((c * gains).sum()) for c in counts]
    assert resampling.weighted_sums([resampling.bit_planes(counts[3])], np.zeros(resampling.BUCKETS, np.int64)).tolist() == [0]


def test_long_texts_are_cut_at_blanks():
    text = b"ab cd" * 700_000 + "é".encode() * 1_500_000 + b" end of the text" * 9
    whole, n = resampling.bucket_counts(text.lower(), 2)
    w = re.findall(rb"[0-9a-z\x80-\xff]+", text)
    want = Counter(zlib.crc32(f) % 10_000 for f in w + [b" ".join(p) for p in zip(w, w[1:])])
    assert n == len(w) and {i: int(v) for i, v in enumerate(whole) if v} == want


# -- conversation repair -------------------------------------------------------------------------------------------

def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        c = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text
        out += [] if c == 0 else [(conv, turn, "user" if c == 4 else role, text)] * (2 if c == 3 else 1)
    return out


def brute_repair(rows):
    """Least (cost, audit) by strings, from the last row back."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1], r[2], r[3][:64], hashlib.md5(r[3].encode()).hexdigest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def insert(best):
        for _ in range(4):
            best = {q: min([best[q]] if q in best else [], default=None) for q in due}
            best = {q: min([x for x in (best[q], best[due[q]] and (best[due[q]][0] + 2, "I" + best[due[q]][1], (f"{name[due[q]]}:",) + best[due[q]][2])) if x is not None], default=None) for q in due}
        return best
    best = insert({"": (0, "", ()), "a": (0, "", ())})
    for (_, _, role, text), fault in zip(reversed(rows), reversed(faults)):
        here, extra = {}, fault == "truncated"
        for q, d in due.items():
            ways = [(best[q][0] + 3, "D" + best[q][1], best[q][2])]
            if fault not in ("blank", "duplicate"):
                to = "s" if role[:1] == "s" and q == "" else d if role[:1] == d else None
                if to:
                    ways.append((best[to][0] + extra, "K" + best[to][1], (f"{role}:{text}",) + best[to][2]))
                ways.append((best[d][0] + 2 + extra, "R" + best[d][1], (f"{name[d]}:{text}",) + best[d][2]))
            here[q] = min(ways)
        best = insert(here)
    cost, audit, lines = best[""]
    turns = [r[1] for r in rows if r[1] is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    count = Counter(faults)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check_repair(spark, rows, block=repair.BLOCK, hurt=False):
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("part", F.lit("x")).withColumn("_key", F.lit(1))
    out = repair.repair(repair.damage(table) if hurt else table, keep_lines=True, block=block).collect()
    by = defaultdict(list)
    for r in rows:
        by[r[0]]
    for r in damaged(rows) if hurt else [(c, t, " " if x is None else x, " " if y is None else y) for c, t, x, y in rows]:
        by[r[0]].append(r)
    got = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in out}
    assert len(out) == len(by) and got == {c: brute_repair(rs) for c, rs in by.items()}
    for r in out:
        assert hashlib.sha256(r["repaired"].encode()).hexdigest() == r["repaired_sha256"]
    return got


def many(n, seed, longest=12):
    rng = np.random.default_rng(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "no", "", None, " \n", "Why? ", "ok!", "Yes", "é…"]
    rows = []
    for conv in range(n):
        for i in range(int(rng.integers(1, longest + 1))):
            turn = None if rng.random() < 0.05 else int(i + rng.integers(0, 2))
            rows.append((conv, turn, roles[int(rng.integers(0, 6)) if rng.random() < 0.4 else i % 2], texts[int(rng.integers(0, 9))] if rng.random() < 0.6 else f"text {i}."))
    return rows


@pytest.mark.parametrize("block", [1, 3, repair.BLOCK])
def test_repair_random(spark, block):
    check_repair(spark, many(150, block), block)
    check_repair(spark, many(60, block + 100) + [(None, 1, "user", "x"), (None, 3, "user", "x"), (-5, None, None, None)], block, hurt=True)


def test_repair_hot_conversation(spark):
    rng = np.random.default_rng(5)
    rows = [(7, i, ["user", "assistant", "system"][int(rng.integers(0, 3))], f"t{int(rng.integers(0, 900))}{'.' if i % 3 else ''}") for i in range(3000)]
    rows += [(8, 1, "user", "same.")] * 700 + many(40, 9)
    check_repair(spark, rows, 64, hurt=True)


def test_repair_query_and_empty(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in queries.QUERIES["op12_conversation_repair"](spark, SMALL).collect()}
    assert got == check_repair(spark, rows, hurt=True)
    assert repair.repair(repair.damage(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).count() == 0


@given(st.lists(st.lists(st.integers(0, 15), max_size=9), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_least_paths_are_segments_of_their_own(segments):
    one = [repair.LeastPaths(np.array(s, np.int64), np.array([len(s)]), np.array([repair._END])) for s in segments]
    all_ = repair.LeastPaths(np.array([c for s in segments for c in s], np.int64), np.array([len(s) for s in segments]), np.tile(repair._END, (len(segments), 1)))
    arcs, sizes, ended = all_.read(np.arange(len(segments)), np.zeros(len(segments), np.int64))
    letters, at = all_.letter[arcs].tolist(), 0
    for p, n, q in zip(one, sizes, ended):
        a, _, e = p.read(np.zeros(1, np.int64), np.zeros(1, np.int64))
        assert p.letter[a].tolist() == letters[at:at + n] and e[0] == q
        at += n


def test_ranks_order_audits():
    p = repair.LeastPaths(np.array([1, 1, 2, 4, 9, 3, 0]), np.array([7]), np.array([repair._END]))
    audits = []
    for arc in range(len(p.letter)):
        word, now = "", arc
        while now != len(p.letter):
            word, now = word + repair.LETTERS[p.letter[now]], p.pointers[0][now]
        audits.append(word)
    assert [audits[i] for i in np.argsort(p.rank[:-1], kind="stable")] == sorted(audits)


# -- sharding ------------------------------------------------------------------------------------------------------

def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b, key = j, (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


IDS = [0, 1, 2, -1, -5, 2**62, -2**63, 2**63 - 1, 123456789012, *range(100, 700)]


@pytest.mark.parametrize("shards,steps", [(1, 64), (24, 64), (500, 3), (100_000, 8)])
def test_jump_hash(spark, shards, steps):
    a, b = sharding.jump_shards(F.col("k"), [shards, shards + 1], steps)
    for r in spark.createDataFrame([(i,) for i in IDS], "k bigint").select("k", a.alias("a"), b.alias("b")).collect():
        assert (r["a"], r["b"]) == (jump(r["k"], shards), jump(r["k"], shards + 1))


def test_shards_and_slots(spark):
    rows = [(i, f"x{i}", 3, i) for i in [*IDS, *[5] * 400, None, None]]
    df = spark.createDataFrame(rows, "doc_id bigint, _row string, shard int, _at bigint").repartition(7)
    out = sharding.shard_rows(df, 24).collect()
    assert Counter((r["doc_id"], r["_row"], r["_at"]) for r in out) == Counter((r[0], r[1], r[3]) for r in rows)
    slots = defaultdict(list)
    for r in out:
        assert r["shard"] == jump(r["doc_id"] or 0, 24) and r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_rows(df.limit(0)).count() == 0
    assert {r["shard"] for r in sharding.assign_shards(df, 8, "_row").collect()} == set(range(8))


def test_few_keys_move(spark):
    moved = spark.range(50_000).select(*[c.alias(n) for c, n in zip(sharding.jump_shards(F.col("id"), [24, 25]), "ab")]).groupBy("a", "b").count().collect()
    assert all(r["b"] in (r["a"], 24) for r in moved)
    share = sum(r["count"] for r in moved if r["b"] == 24) / 50_000
    assert 0.035 < share < 0.045


def test_sharding_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    out = queries.QUERIES["op13_jump_sharding"](spark, SMALL).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in out} == {
        (d, len(t.encode()) + 8, zlib.crc32(t.encode()), jump(d, 24), jump(d, 25)) for d, t in docs.items()}
    assert len(out) == len(docs) and {r["law"] for r in out} == {"key"}


def test_write_shards(spark, tmp_path):
    sharding.write_shards(spark.createDataFrame([(i, "t") for i in range(50)], "doc_id bigint, text string"), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and {r["shard"] for r in back.select("shard").distinct().collect()} <= set(range(4))


# -- URL lists -----------------------------------------------------------------------------------------------------

def test_url_lists_sql_with_capitals(spark, tmp_path):
    import duckdb

    from tests.compare import compare
    paths = ["A/Story", "a/story", "A/Story/2", "", "News", "news/x", None]
    rows = [(i, None if p is None else f"{'HTTP' if i % 5 else 'http'}://{'WWW' if i % 3 else 'www'}.Site{i % 4}.org:80/{p}{'?q=A' if i % 2 else ''}") for i, p in ((i, paths[i * 5 % 7]) for i in range(140))]
    spark.createDataFrame(rows, "page_id bigint, url string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    out = queries.QUERIES["op3_url_lists"](spark, str(tmp_path))
    assert compare(out, con, queries.SQL["op3_url_lists"]) is None
    assert any("/A/" in (r["pattern"] or "") for r in out.collect())
