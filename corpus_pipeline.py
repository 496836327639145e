"""The corpus pipeline: language ID, quality rules, line dedup, near-duplicate removal, packing.

Each stage takes the documents that the one before kept, as a stored table, and returns documents with the same columns;
the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from linespark.llm import language_id, line_dedup, packing, parity_join, quality_rules
from linespark.llm.common import keep, table
from linespark.llm.queries import tokenizer_path

#: Below this score a prediction counts as no language; texts that are like no learned language are below it (``language_id.REJECT``).
MIN_SCORE = 0.25
NEAR_WORDS = 5
NEAR_PERCENT = 80
#: Up to so many ids (16 MB at most) of near duplicates are sent to every task, so that no text moves; more are joined by shuffle.
FEW_IDS = 500_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language: no text, no letter, or like none of the labelled languages.

    Each row is judged by its own text, whatever its id. Without one labelled text no language is known and every document goes.
    Raises if ``docs`` has a column ``lang_pred`` or ``score``.
    """
    model = language_id.fit(docs)
    return language_id.predict(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or are outliers of their language and source; each row by its own text, whatever its id."""
    return quality_rules.judge(docs, carry_text=True).filter("kept").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that several documents share; the document keeps its other lines. Rows with one id are one document, those with a null id none."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest ``doc_id`` of each near-duplicate group.

    Rows that share an id are one document, stay or go together, and are not compared with each other; rows with a null id are compared with nothing and stay.
    """
    grouped = parity_join.near_duplicates(docs.select("doc_id", "text"), NEAR_WORDS, NEAR_PERCENT)
    extra = keep(grouped.filter("doc_id <> component_id").select("doc_id").distinct())
    if extra.count() <= FEW_IDS:
        extra = F.broadcast(extra)
    return docs.join(extra, "doc_id", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces with their token ids; every row is packed, whatever its id, a null text as the end id alone."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language_id", identify_language), ("quality_rules", apply_quality_rules), ("line_dedup", drop_repeated_lines),
          ("ngram_jaccard_join", drop_near_duplicates), ("packing", pack_sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
