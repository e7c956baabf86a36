"""The corpus pipeline: five stages over documents, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import pipeline

STAGES = pipeline.STAGES
ORACLE_SQL = None  # rounding, coin flips and tokens are beyond SQL: tests/llm checks them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    return pipeline.run(spark, sf_dir)
