"""The corpus pipeline's stages: functions of (spark, documents, folder of tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.llm import bpe, mixing, simhash, substrings, toxicity
from tillroll.llm.common import read_table, stored


def vocabulary_path() -> str:
    """The public vocabulary file that the queries encode with."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar does not reject."""
    labels = toxicity.training_rows(read_table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels), threshold=0.5)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.drop_near_duplicates(docs, shingle=3, max_distance=3)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; the number of characters follows the text."""
    left = substrings.drop_repeats(docs, window=20)
    return left.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in left.columns else left


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take(docs, weights=(5, 2, 1), cap=3)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document: their number, and digests of the ids and of the decoded text."""
    return bpe.encode_decode(docs, vocabulary_path(), digest=True).select(
        "row.doc_id", "row.source", "n_tokens",
        F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
