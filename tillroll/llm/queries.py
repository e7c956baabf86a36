"""The operators as queries over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from tillroll.llm import (
    bpe, importance, language_model, line_dedup, mixing, parsing, pipeline, quality_model, quality_rules, simhash,
    substrings, toxicity, url_rules, vector_codes,
)
from tillroll.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, max_distance=3)
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id")


def _judged(found: DataFrame, threshold: float) -> DataFrame:
    doc_id = F.col("row.doc_id")
    return found.select(
        doc_id.alias("doc_id"), toxicity.held_out(doc_id).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit(docs, toxicity.training_rows(read_table(spark, sf_dir, "labels")))
    return _judged(quality_model.score(docs, model), 0.3)


def fitted_grammar(spark: SparkSession, sf_dir: str) -> toxicity.Grammar:
    labels = toxicity.training_rows(read_table(spark, sf_dir, "labels"))
    return toxicity.fit(read_table(spark, sf_dir, "documents"), labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(toxicity.score(docs, fitted_grammar(spark, sf_dir)), 0.5)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(
        read_table(spark, sf_dir, "documents").select("doc_id", "text"), window=20, digest=True)
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


# The rules of the query.
URL_RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    found = url_rules.match(read_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return found.select("row.page_id", "host", "path", "rule", "verdict")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_model.score(
        read_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    return found.withColumnRenamed("id", "doc_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"),
                       weights=(5, 2, 1), cap=3, keep=["doc_id"])
    return found.select("row.doc_id", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).alias("taken"))


def op8_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parsing.compare_edited(read_table(spark, sf_dir, "documents"), digest=True)
    return found.withColumnsRenamed({"id": "doc_id", "edited": "edited_sha256"})


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_words, n_repeat = F.col("counts.w.n_words").cast("long"), F.col("counts.w.n_repeat_words").cast("long")
    base_failed = (n_words < 10) | (100 * n_repeat > 20 * n_words)
    return found.select(
        "row.doc_id", n_words.alias("n_words"), F.col("counts.word_chars").cast("long").alias("word_chars"),
        F.col("counts.n_symbols").cast("long").alias("n_symbols"),
        F.col("counts.l.n_dup_lines").cast("long").alias("n_dup_lines"), n_repeat.alias("n_repeat_words"),
        base_failed.alias("base_failed"), (~base_failed & F.col("kept")).alias("kept"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_decode(
        read_table(spark, sf_dir, "documents").select("doc_id", "text"), pipeline.vocabulary_path(), digest=True)
    return found.select(
        "row.doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(
        read_table(spark, sf_dir, "documents").select("doc_id", "text"),
        read_table(spark, sf_dir, "benchmark").select("text"), percent=5, least_words=20, seed=42)
    return found.select("row.doc_id", "n_features", "weight", "score", "rank")


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(
        read_table(spark, sf_dir, "documents").select("doc_id", "text"), least_chars=20, least_docs=3)
    return found.select(
        "row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vector_codes.fit(vectors, parts=8, entries=16, rounds=6, scale=4096)
    found = vector_codes.label_errors(vector_codes.compress(vectors, books, scale=4096))
    return found.select(
        "row.vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256"))


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": op1_simhash,
        "op2_quality": op2_quality,
        "op3_toxicity": op3_toxicity,
        "op4_substrings": op4_substrings,
        "op5_urls": op5_urls,
        "op6_language_model": op6_language_model,
        "op7_mixing": op7_mixing,
        "op8_parsing": op8_parsing,
        "op9_bpe": op9_bpe,
        "op10_rules": op10_rules,
        "op11_importance": op11_importance,
        "op12_lines": op12_lines,
        "op13_codes": op13_codes,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; tests/llm checks the others against brute force."""
    from tillroll.llm import oracle

    return oracle.statements() | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
