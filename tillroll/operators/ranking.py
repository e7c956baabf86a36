"""Top, bottom and ranked products and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tillroll.operators.explore import customer_revenue
from tillroll.operators.totals import resolve_reduced, totals_by_dimension


def product_revenue(fact: DataFrame, products: DataFrame) -> DataFrame:
    return totals_by_dimension(
        fact, products, "product_key", ["product_name"], total_revenue=(F.sum, "sales_amount"))


def top_products(fact: DataFrame, products: DataFrame, n: int = 5) -> DataFrame:
    revenue = product_revenue(fact, products)
    return revenue.orderBy(F.col("total_revenue").desc_nulls_last(), "product_name").limit(n)


def ranked_products(fact: DataFrame, products: DataFrame, n: int = 5) -> DataFrame:
    """Products ranked n or better, ties kept.

    Spark turns the filter on the rank into a per-task cut before the one-task window, which
    then sees only each task's own first ranks.
    """
    best_first = Window.orderBy(F.col("total_revenue").desc_nulls_last())
    ranked = product_revenue(fact, products).withColumn("rank_products", F.rank().over(best_first))
    return ranked.where(F.col("rank_products") <= n)


def bottom_products(fact: DataFrame, products: DataFrame, n: int = 5) -> DataFrame:
    revenue = product_revenue(fact, products)
    return revenue.orderBy(F.col("total_revenue").asc_nulls_first(), "product_name").limit(n)


def top_customers(fact: DataFrame, customers: DataFrame, n: int = 10) -> DataFrame:
    revenue = customer_revenue(fact, customers)
    return revenue.orderBy(F.col("total_revenue").desc_nulls_last(), "customer_key").limit(n)


def fewest_orders(
    fact: DataFrame, customers: DataFrame, n: int = 3, keys_verified: bool = False
) -> DataFrame:
    """Customers with the fewest distinct orders, among those with a sales line.

    ``keys_verified`` asserts that the fact has no dangling customer key and spares the lookup, which
    sees customers and orders, not lines. The cut is made on keys and counts, before names are attached.
    """
    pairs = fact.select("customer_key", "order_number").distinct().withColumn(
        "_order", F.col("order_number").isNotNull().cast("int"))
    if not keys_verified:
        pairs = resolve_reduced(pairs, customers, "customer_key", "order_number", "_order")
    counts = pairs.groupBy("customer_key").agg(F.sum("_order").alias("total_orders"))
    fewest_first = [F.col("total_orders").asc(), F.col("customer_key").asc_nulls_first()]
    fewest = counts.orderBy(*fewest_first).limit(n)
    names = customers.select("customer_key", "first_name", "last_name")
    return fewest.join(names, "customer_key", "left").select(
        "customer_key", "first_name", "last_name", "total_orders").orderBy(*fewest_first)
