"""Readers for raw extracts and stored tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tillroll import schemas


def _csv_reader(reader, schema: StructType, multi_line: bool = False):
    return (
        reader.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("enforceSchema", False)  # a header that disagrees with the schema is an error
        .option("mode", "FAILFAST")      # so is a record with too few or too many values
        .option("columnPruning", False)  # which shows only if records are parsed whole
        .option("escape", '"')
        .option("dateFormat", "yyyy-MM-dd")
    )


def read_bronze(spark: SparkSession, name: str, path: str, multi_line: bool = False) -> DataFrame:
    """One raw extract, every column text, blanks as ``''`` rather than NULL.

    ``multi_line`` accepts quoted values with line breaks; such files cannot be split.
    """
    return _csv_reader(spark.read, schemas.BRONZE[name], multi_line).csv(path).na.fill("")


def read_bronze_all(
    spark: SparkSession, paths: dict[str, str], multi_line: Iterable[str] = ()
) -> dict[str, DataFrame]:
    """Raw extracts by name; ``multi_line`` names those that hold quoted line breaks."""
    broken = set(multi_line)
    return {name: read_bronze(spark, name, path, name in broken) for name, path in paths.items()}


def stream_bronze(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """New CSV files of one extract, read by the rules of `read_bronze`."""
    return _csv_reader(spark.readStream, schemas.BRONZE[name]).csv(folder).na.fill("")


def read_table(spark: SparkSession, schema: StructType, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored table with its declared schema, as Parquet or as CSV."""
    if fmt == "csv":
        return _csv_reader(spark.read, schema).csv(path)
    return spark.read.schema(schema).format(fmt).load(path)


def load_fact(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, schemas.FACT_SALES, path, fmt)


def load_customers(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, schemas.DIM_CUSTOMERS, path, fmt)


def load_products(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, schemas.DIM_PRODUCTS, path, fmt)


def load_report_customers(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, schemas.REPORT_CUSTOMERS, path, fmt)


def load_report_products(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, schemas.REPORT_PRODUCTS, path, fmt)
