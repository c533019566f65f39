"""Corpus pipeline: quality filter, near-dedup, repeated passages, benchmark
decontamination, tokenizing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it as Parquet to the shared folder and hands the reread table to the
next stage, so no stage is computed twice and a lost executor costs no earlier
stage. All but the last return the columns of ``documents``.

Defined cases: a document is told apart by its id and its text's hash, so different
texts under one id are decided one by one, and rows with one id and text are one
document. Rows with a null ``doc_id`` pass the near-dedup stage unchanged; the
other stages decide on them as on any others. Null or empty texts are scored and
fingerprinted as texts without words. A text that consists of repeated passages
(and white space) only is dropped by the third stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.llm import bpe, decontam, quality, simhash, suffix_dedup
from tonemill.llm.ragged import released, table, train_rows, written

KEEP_SCORE = 0.3
# 51 words of prose take 236 bytes or more in 99 of 100 places (sf0.1), 153 in 999 of 1,000.
PASSAGE_BYTES = 200
PASSAGE_WORDS = 51


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score 0.3 or more; the model is fitted on the
    labelled documents that are not held out."""
    labels = table(spark, sf_dir, "labels").where(train_rows(F.col("doc_id"), 5, 0))
    stats = written(quality.with_statistics(docs.select("doc_id", "text")).select("doc_id", "statistics"), "statistics")
    model = quality.fit(quality.labelled(stats, labels, "quality"))
    slim = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return quality.score_texts(slim, model).where(F.col("score") >= KEEP_SCORE).select("row.*")


def keyed(docs: DataFrame) -> DataFrame:
    """Add ``key``, by which a document is told apart: its id and its text's hash."""
    return docs.withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("hash")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component: of its smallest id, the text
    with the smallest hash."""
    named = keyed(docs.where("doc_id is not null"))
    groups = simhash.near_duplicates(named.select("key", "text"), key="key", shingle=3, max_bits=3)
    kept = written(groups.where("key = component_id").groupBy(F.col("key").alias("kept")).count(), "kept")
    named = named.hint("merge").join(kept.select("kept"), F.col("key") == F.col("kept"), "left_semi")
    if kept.where("count > 1").limit(1).count():  # rows with one id and text are one document
        named = named.dropDuplicates(["key"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages of over 50 words out of the texts: what strings of
    PASSAGE_BYTES that stand anywhere else cover, in runs of PASSAGE_WORDS or
    more. Characters that lose a byte go whole, texts that keep nothing go."""
    out = suffix_dedup.strip_repeats(docs, length=PASSAGE_BYTES, least_words=PASSAGE_WORDS)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    out = out.withColumn("text", text).where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return out.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    docs = keyed(docs)
    held = decontam.matches(docs.select("key", "text"), table(spark, sf_dir, "benchmark"), key="key").select(F.col("key").alias("held")).distinct()
    held = written(held, "held")
    return docs.join(decontam.within(held.count(), held), F.col("key").eqNullSafe(F.col("held")), "left_anti").drop("key")


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left and decode it again: id, tokens and digests."""
    out = bpe.encode(docs.select("doc_id", "text"), vocabulary=bpe.default_vocabulary(), decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("repeats", repeats_stage),
    ("decontamination", decontamination_stage),
    ("tokenize", tokenize_stage),
]

# Hashing, a trained model and components are not SQL; tests/llm hold the
# pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        released(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
