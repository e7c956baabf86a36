"""Data-quality checks: each returns findings or measures as a frame and never fails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.functions.numbers import total
from tillroll.operators.insights import kpis


def _inline(rows: DataFrame, names: list[str], name: str, value: str) -> DataFrame:
    """One output row per measured column."""
    entries = F.array(*[
        F.struct(F.lit(n).alias(name), F.col(f"_{i}").alias(value)) for i, n in enumerate(names)])
    return rows.select(F.inline(entries))


def null_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs per column, in one pass."""
    counted = rows.agg(*[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(columns)])
    return _inline(counted, columns, "column_name", "nulls")


def orphan_keys(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Fact keys, NULL included, the dimension does not know, with their line counts."""
    used = fact.groupBy(key).agg(F.count("*").alias("lines"))
    return used.join(dimension.select(key), key, "left_anti")


def join_coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows in which a looked-up column is filled."""
    covered = rows.agg(*[
        F.avg(F.col(c).isNotNull().cast("double")).alias(f"_{i}") for i, c in enumerate(columns)])
    return _inline(covered, columns, "column_name", "coverage")


def duplicate_keys(dimension: DataFrame, key: str) -> DataFrame:
    """Dimension keys that occur more than once."""
    return dimension.groupBy(key).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def _sides(left: DataFrame, right: DataFrame, measure: Column) -> DataFrame:
    """A measure of two builds side by side, without joining them."""
    tagged = left.agg(measure.alias("value")).withColumn("side", F.lit("left")).unionByName(
        right.agg(measure.alias("value")).withColumn("side", F.lit("right")))
    return tagged.agg(
        F.max(F.when(F.col("side") == "left", F.col("value"))).alias("left_value"),
        F.max(F.when(F.col("side") == "right", F.col("value"))).alias("right_value"))


def row_count_match(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    """Row counts of two builds of the same tables."""
    checks = [
        _sides(left[name], right[name], F.count("*")).select(
            F.lit(name).alias("table_name"), F.col("left_value").alias("left_rows"),
            F.col("right_value").alias("right_rows"),
            (F.col("left_value") == F.col("right_value")).alias("matches"))
        for name in left
    ]
    return reduce(DataFrame.unionByName, checks)


def revenue_reconciliation(left: DataFrame, right: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Revenue of two facts, the difference relative to the right one, and whether it is tolerable."""
    sums = _sides(left, right, total(F.col("sales_amount")))
    difference = F.abs(F.col("left_value") - F.col("right_value")).cast("double")
    relative = F.try_divide(difference, F.col("right_value").cast("double"))
    return sums.select(
        F.col("left_value").alias("left_revenue"), F.col("right_value").alias("right_revenue"),
        relative.alias("relative_difference"), (relative < tolerance).alias("within_tolerance"))


def kpi_sanity(sales: DataFrame) -> DataFrame:
    """Invariants of the headline figures, one flag each."""
    return kpis(sales).select(
        (F.col("revenue") > 0).alias("has_revenue"),
        (F.col("orders") > 0).alias("has_orders"),
        (F.col("customers") > 0).alias("has_customers"),
        (F.col("profit") <= F.col("revenue")).alias("profit_within_revenue"),
        F.col("margin").between(0, 100).alias("margin_in_range"),
        (F.abs(F.col("aov") * F.col("orders") - F.col("revenue"))
         <= F.abs(F.col("revenue")) * 1e-6).alias("aov_is_revenue_per_order"),
    )
