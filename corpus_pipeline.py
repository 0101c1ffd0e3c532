"""From raw documents to packed training sequences, as a chain of stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before
kept; ``run`` writes what a stage returns as Parquet to the shared folder and reads it
back as the next one's input. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm import jaccard, packing, pii, substrings, toxicity
from ledgerscope.llm.common import saved
from ledgerscope.llm.queries import BYTE_BPE, tokenizer

TOXIC_FROM = 0.5
SIMILAR_PERCENT = 75
CAPACITY = 2048


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit; empty texts are scored like all others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")
    scored = toxicity.score(rows, *toxicity.fit(toxicity.training_rows(docs, labels)), keep=("row", "text"))
    return scored.where(F.col("score") < TOXIC_FROM).select("row.*", "text").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, one without an id only
    where none has one; of equal rows one stays."""
    # Rows are told apart by id and text, since ids may be missing or come several times.
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))
    groups = saved(jaccard.near_duplicates(docs.select(key.alias("doc_id"), "text"), SIMILAR_PERCENT), "groups")
    stays = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id")
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    kept = rows.join(stays.distinct().select(F.col("doc_id").alias("stays")), F.col("key").eqNullSafe(F.col("stays")), "left_semi")
    if not stays.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["key"])
    return kept.select("row.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the words of passages that occur elsewhere; a text without any is left as it is."""
    cleaned = substrings.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return cleaned.select("row.*", text.alias("text")).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by the kind of it."""
    return pii.redact(docs, pii.fit(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences."""
    return packing.best_fit_packing(docs, tokenizer(BYTE_BPE), CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: Hashing, learning and packing cannot be stated in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; returns what the last one gives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
