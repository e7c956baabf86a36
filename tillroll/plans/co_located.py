"""The sales frame from tables bucketed by customer: no line is shuffled for a customer lookup.

The fact is stored twice over, as two tables without a common customer. ``<name>_cold`` is bucketed and
sorted by customer, so that sums by customer and the customer join read each bucket as it lies.
A bucket is one task's work, so lines of customers with more than ``hot_lines`` lines, and lines without a
customer, which would all lie in one bucket, go to ``<name>_hot``. That table is not bucketed; its
lines are shuffled for the join, where adaptive execution splits a hot customer.
"""

from __future__ import annotations

import datetime as dt
import posixpath

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillroll.plans.sales_model import build_sales

KEY = "customer_key"
HOT_LINES = 1_000_000
BUCKET_LINES = 1_000_000  # of one task


def _save(rows: DataFrame, name: str, folder: str, buckets: int | None = None) -> None:
    writer = rows.write.mode("overwrite").option("path", posixpath.join(folder, name))
    if buckets:
        writer = writer.bucketBy(buckets, KEY).sortBy(KEY)
    writer.saveAsTable(name)


def store_by_customer(fact: DataFrame, customers: DataFrame, name: str, folder: str, buckets: int,
                      hot_lines: int = HOT_LINES) -> None:
    """Store fact and customers as catalog tables ``<name>_cold``, ``<name>_hot`` and ``<name>_customers``.

    ``buckets`` is the least number of them, and stays with the tables. A bucket is sorted in one task, so
    there are more if they would hold over ``BUCKET_LINES`` lines each. The lines are dealt out by
    customer before they are written, so each bucket is one file.
    """
    if buckets < 1 or hot_lines < 1:
        raise ValueError("buckets and hot_lines are at least 1")
    per_key = fact.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count("*").alias("_lines"))
    hot_keys = per_key.where(F.col("_lines") > hot_lines).select(KEY)  # fewer than lines / hot_lines
    cold_lines = per_key.where(F.col("_lines") <= hot_lines).agg(F.sum("_lines")).first()[0] or 0
    buckets = max(buckets, -(-cold_lines // BUCKET_LINES))
    _save(fact.join(hot_keys, KEY, "left_semi").unionByName(fact.where(F.col(KEY).isNull())), f"{name}_hot", folder)
    cold = fact.where(F.col(KEY).isNotNull()).join(hot_keys, KEY, "left_anti")
    _save(cold.select(*fact.columns).repartition(buckets, KEY), f"{name}_cold", folder, buckets)
    _save(customers.repartition(buckets, KEY), f"{name}_customers", folder, buckets)


def build_co_located(
    spark: SparkSession, name: str, products: DataFrame, as_of: dt.date | Column | None = None, **options,
) -> DataFrame:
    """`build_sales` from the tables of ``store_by_customer``; options are those of `build_sales`.

    All lines of a customer are in one of the two tables, so first years and segments, which look at a
    customer's whole history, are right in each.
    """
    customers = spark.table(f"{name}_customers")
    cold = build_sales(spark.table(f"{name}_cold"), products, customers, as_of=as_of, co_located=True, **options)
    hot = build_sales(spark.table(f"{name}_hot"), products, customers, as_of=as_of, **options)
    return cold.unionByName(hot)
