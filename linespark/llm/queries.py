"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (conversation_repair, importance_resampling, language_id, line_dedup, lm_scoring, multiprobe_lsh, packing, parity_join, quality_rules, sentence_pieces, sharding,
               url_lists, word_piece_counts)
from .common import crc32_of_id, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op4_language_id")
def op4(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(crc32_of_id() % 4 != 2))
    held_out = F.coalesce(crc32_of_id() % 4 == 2, F.lit(False))
    return language_id.predict(docs.drop("lang"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op5_packing")
def op5(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op8_quality_rules")
def op8(spark, sf):
    return quality_rules.judge(table(spark, sf, "documents").select("doc_id", "text", "lang", "source")).select(
        "doc_id", *quality_rules.STATS, "base_failed", "kept", "distance")


@query("op9_line_dedup", f"""
WITH lines AS (SELECT doc_id, i, parts[i] AS line FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
keyed AS (SELECT *, {LOWER.format(f"trim(line, {BLANKS})")} AS key FROM lines),
blocked AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.*, b.key IS NOT NULL AND k.doc_id <> b.keeper AS gone FROM keyed k LEFT JOIN blocked b USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""")
def op9(spark, sf):
    out = line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op10_parity_join", f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM words),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE 100 * c >= 85 * (m.n + n.n - c)),
reach AS (SELECT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS component FROM reach GROUP BY doc_id) c USING (doc_id)""")
def op10(spark, sf):
    return parity_join.near_duplicates(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


@query("op7_multiprobe_lsh")
def op7(spark, sf):
    return multiprobe_lsh.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op6_word_piece_counts")
def op6(spark, sf):
    return word_piece_counts.count_pieces(table(spark, sf, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


@query("op2_sentence_pieces")
def op2(spark, sf):
    path = tokenizer_path("piece_bpe_32k.model")
    encoded = sentence_pieces.encode(table(spark, sf, "documents").select("doc_id", "text"), path)
    return sentence_pieces.decode(encoded, path).select("doc_id", "n_pieces", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """List entries made from the pages' own URLs: every seventh page lists its domain, host or path, and every second of these is taken off again."""
    place = url_lists.normal_url(F.col("url"))
    host = F.element_at(F.split(place, "/"), 1)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 11 % 300).cast("int"))
    listed = pages.filter("page_id % 7 = 0").select(
        F.concat(F.lit("list"), (F.col("page_id") % 3).cast("string")).alias("list_id"), "page_id", day.alias("day"),
        F.when(F.col("page_id") % 4 == 0, F.regexp_extract(host, "([^.]+\\.[^.]+\\.[^.]+)$", 1)).when(F.col("page_id") % 4 == 1, host).otherwise(place).alias("pattern"))
    listed = listed.filter("pattern <> ''")
    return listed.select("list_id", "pattern", "day", F.lit("add").alias("action")).unionByName(
        listed.filter("page_id % 2 = 0").select("list_id", "pattern", F.date_add("day", 45).alias("day"), F.lit("remove").alias("action")))


@query("op3_url_lists", r"""
WITH places AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '') AS rest FROM pages),
parts AS (SELECT page_id, lower(regexp_replace(regexp_replace(regexp_extract(rest, '^([^/]*)', 1), '^.*@', ''), ':[0-9]*$', '')) AS host,
  regexp_replace(regexp_extract(rest, '^[^/]*(/.*)$', 1), '/+$', '') AS path FROM places),
p AS (SELECT page_id, host, host || path AS place, DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER) AS fetched FROM parts),
listed AS (SELECT 'list' || (page_id % 3) AS list_id, page_id, DATE '2024-01-01' + CAST(page_id * 11 % 300 AS INTEGER) AS day,
  CASE page_id % 4 WHEN 0 THEN regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) WHEN 1 THEN host ELSE place END AS pattern FROM p WHERE page_id % 7 = 0),
entries AS (SELECT list_id, pattern, day, 'add' AS action FROM listed WHERE pattern <> '' UNION ALL
  SELECT list_id, pattern, day + 45, 'remove' FROM listed WHERE pattern <> '' AND page_id % 2 = 0),
hits AS (SELECT p.page_id, e.list_id, e.pattern, max(struct_pack(day := e.day, action := e.action)) AS newest
  FROM p JOIN entries e ON e.day <= p.fetched AND (p.host = e.pattern OR ends_with(p.host, '.' || e.pattern) OR (contains(e.pattern, '/') AND (p.place = e.pattern OR starts_with(p.place, e.pattern || '/'))))
  GROUP BY ALL),
found AS (SELECT page_id, count(*) AS n_entries, min(pattern) AS pattern FROM hits WHERE newest.action = 'add' GROUP BY page_id)
SELECT p.page_id AS capture_id, p.fetched, f.page_id IS NOT NULL AS blocked, coalesce(n_entries, 0) AS n_entries, pattern FROM p LEFT JOIN found f USING (page_id)""")
def op3(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 365).cast("int")).alias("fetched"))
    return url_lists.filter_urls(captures, dated_entries(pages)).select("capture_id", "fetched", "blocked", "n_entries", "pattern")


@query("op1_lm_scoring", f"""
WITH words AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, list_prepend(chr(0), w) AS w, unnest(range(1, len(w) + 1)) AS i FROM words),
pairs AS (SELECT doc_id, w[i] AS v, w[i + 1] AS w, count(*) AS n FROM places GROUP BY ALL),
uses AS (SELECT doc_id, unnest(list_prepend(chr(0), w)) AS word FROM words WHERE len(w) > 0),
own AS (SELECT doc_id, word, count(*) AS o FROM uses GROUP BY ALL),
counts AS (SELECT word, sum(o) AS c FROM own GROUP BY word),
total AS (SELECT sum(c) AS t FROM counts WHERE word <> chr(0)),
outside AS (SELECT *, sum(n) OVER (PARTITION BY v, w) - n AS c FROM pairs),
scored AS (SELECT x.doc_id, x.n, CASE WHEN x.c > 0 THEN ln(CAST(x.c AS DOUBLE) / (cv.c - o.o)) ELSE ln(0.4 * cw.c / t) END AS s
  FROM outside x JOIN own o ON o.doc_id = x.doc_id AND o.word = x.v JOIN counts cv ON cv.word = x.v JOIN counts cw ON cw.word = x.w, total),
sums AS (SELECT doc_id, sum(n) AS n_words, sum(n * s) AS log_score FROM scored GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(log_score, 4) AS log_score, round(log_score / n_words, 6) AS mean_score FROM documents LEFT JOIN sums USING (doc_id)""")
def op1(spark, sf):
    return lm_scoring.score_documents(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_score", 6).alias("mean_score"))


@query("op11_bit_sliced_resampling", f"""
WITH RECURSIVE table_steps AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM table_steps WHERE k < 8),
steps AS (SELECT i, c FROM table_steps WHERE k = 8),
words AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
features AS (SELECT doc_id, unnest(w) AS f FROM words),
target AS (SELECT unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
vocabulary AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM features UNION SELECT f FROM target)),
crc AS (SELECT f, h, 1 AS pos, 4294967295::BIGINT AS c FROM vocabulary
  UNION ALL SELECT f, h, pos + 2, xor(x.c >> 8, s.c) FROM crc x JOIN steps s ON s.i = xor(x.c & 255, CAST('0x' || substr(x.h, x.pos, 2) AS BIGINT)) WHERE x.pos < length(x.h)),
buckets AS (SELECT f, xor(c, 4294967295) % 10000 AS b FROM crc WHERE pos > length(h)),
corpus AS (SELECT b, count(*) AS s FROM features JOIN buckets USING (f) GROUP BY b),
aim AS (SELECT b, count(*) AS t FROM target JOIN buckets USING (f) GROUP BY b),
gains AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT sum(s) FROM corpus) + 10000) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM aim) + 10000.0::DOUBLE)))) AS BIGINT) AS gain
  FROM corpus FULL JOIN aim USING (b)),
weighed AS (SELECT doc_id, len(w) AS n_features, CAST(coalesce(floor(g / CAST(len(w) AS DOUBLE)), 0) AS BIGINT) AS weight FROM words
  LEFT JOIN (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS g FROM features JOIN buckets USING (f) JOIN gains USING (b) GROUP BY doc_id) USING (doc_id)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM weighed),
placed AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS r, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM placed""")
def op11(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return importance_resampling.resample(docs, table(spark, sf, "benchmark").select("text")).select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_conversation_repair")
def op12(spark, sf):
    damaged = conversation_repair.damage(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))
    return conversation_repair.repair(damaged).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@query("op13_jump_sharding")
def op13(spark, sf):
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf, "documents").select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shard_rows(rows).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
