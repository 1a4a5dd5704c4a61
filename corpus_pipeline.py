"""Corpus pipeline: documents in, packed token sequences out.

Five stages, each calling one operator of ``retentio.llm`` on everything its
predecessor kept.  A stage's result is written as Parquet in the shared
checkpoint folder and read back as the next one's ``docs``, so a lost executor
re-reads files instead of recomputing the stages before.

Rows without a doc_id take part in every stage and are judged by their text;
near-dedup leaves a group in which no row has an id whole, because no row of
it can be named.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm import decontam, langid, linededup, neardup, packing
from retentio.session import cut_lineage
from retentio.sources.tables import read_table

MIN_LANGUAGE_SCORE = 0.35  # below this no language is clearly ahead
TOKENIZER = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts without a letter or without a clear language go."""
    model = langid.train(docs.select("text", "lang"))
    judged = langid.identify(docs, model, min_score=MIN_LANGUAGE_SCORE)
    return judged.where((F.col("lang_pred") != langid.UNDETERMINED) & ~F.col("ambiguous")).select(*docs.columns)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; one that holds nothing else stays whole, ``n_chars`` follows the text."""
    cleaned = linededup.dedup_lines(docs, spare_emptied=True)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn(
            "n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays; of repeated rows one stays."""
    judged = neardup.near_duplicates(docs)
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash")).distinct()
    left = docs.join(gone, docs.doc_id.eqNullSafe(gone.g_id) & (F.xxhash64(docs.text) == gone.g_hash), "left_anti")
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id", F.xxhash64("text").alias("h")).count().where("count > 1")
    if repeated.isEmpty():
        return left
    return left.withColumn("_h", F.xxhash64("text")).withColumn(
        "_n", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    ).dropDuplicates(["doc_id", "_h", "_n"]).drop("_h", "_n")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_leaks(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents, packed into sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_recurring_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# Classifier training, template trees and the tokenizer have no SQL form; tests/llm checks run() stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
