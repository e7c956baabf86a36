"""Customer and product reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.functions.dates import as_of_date, months_crossed, years_crossed
from tillroll.functions.numbers import int_divide
from tillroll.operators import labels
from tillroll.operators.totals import order_totals


def _dated_lines(fact: DataFrame) -> DataFrame:
    return fact.where(F.col("order_date").isNotNull()).select(
        "customer_key", "product_key", "order_number", "order_date", "sales_amount", "quantity")


def _per_month(sales: Column, lifespan: Column) -> Column:
    return F.when(lifespan == 0, sales).otherwise(int_divide(sales, lifespan))


def report_customers(
    fact: DataFrame,
    customers: DataFrame,
    as_of: dt.date | Column | None = None,
    *,
    segment_months: int = labels.SEGMENT_MONTHS,
    segment_spend: int = labels.SEGMENT_SPEND,
    as_written: bool = False,
    keys_verified: bool = False,
) -> DataFrame:
    """Activity, age, segment and averages per customer with a dated sales line.

    ``as_written=True`` gives the historical layout, in which ``lifespan`` holds the product
    count and ``total_products`` is missing. ``keys_verified`` asserts that the fact has no
    dangling customer key.
    """
    totals = order_totals(_dated_lines(fact), "customer_key", "product_key", "total_products",
                          dimension=None if keys_verified else customers)
    today = as_of_date(as_of)
    people = customers.select(
        "customer_key",
        "customer_number",
        F.concat(F.coalesce("first_name", F.lit("")), F.lit(" "), F.coalesce("last_name", F.lit("")))
        .alias("customer_name"),
        years_crossed(F.col("birthdate"), today).alias("age"),
    )
    lifespan = F.col("lifespan")
    rows = totals.withColumn(
        "lifespan", months_crossed(F.col("first_date"), F.col("last_date"))
    ).join(people, "customer_key", "left")
    report = rows.select(
        "customer_key",
        "customer_number",
        F.coalesce("customer_name", F.lit(" ")).alias("customer_name"),
        "age",
        labels.age_group(F.col("age")).alias("age_group"),
        labels.customer_segment(lifespan, F.col("total_sales"), segment_months, segment_spend)
        .alias("customer_segment"),
        F.col("last_date").alias("last_order_date"),
        months_crossed(F.col("last_date"), today).alias("recency"),
        "total_orders",
        "total_sales",
        "total_quantity",
        "total_products",
        "lifespan",
        F.when(F.col("total_sales") == 0, 0)
        .otherwise(int_divide(F.col("total_sales"), F.col("total_orders"))).alias("avg_order_value"),
        _per_month(F.col("total_sales"), lifespan).alias("avg_monthly_spend"),
    )
    if as_written:
        return report.drop("lifespan").withColumnRenamed("total_products", "lifespan")
    return report


def report_products(
    fact: DataFrame,
    products: DataFrame,
    as_of: dt.date | Column | None = None,
    *,
    limits: tuple = labels.PRODUCT_LIMITS,
    keys_verified: bool = False,
) -> DataFrame:
    """Activity, performance segment and averages per product with a dated sales line."""
    totals = order_totals(_dated_lines(fact), "product_key", "customer_key", "total_customers", with_price=True,
                          dimension=None if keys_verified else products)
    attributes = products.select("product_key", "product_name", "category", "subcategory", "cost")
    lifespan = F.col("lifespan")
    rows = totals.withColumn(
        "lifespan", months_crossed(F.col("first_date"), F.col("last_date"))
    ).join(attributes, "product_key", "left")
    return rows.select(
        "product_key",
        "product_name",
        "category",
        "subcategory",
        "cost",
        F.col("last_date").alias("last_sale_date"),
        months_crossed(F.col("last_date"), as_of_date(as_of)).alias("recency_in_months"),
        labels.product_segment(F.col("total_sales"), limits).alias("product_segment"),
        "lifespan",
        "total_orders",
        "total_sales",
        "total_quantity",
        "total_customers",
        F.round(F.col("avg_unit_price"), 1).alias("avg_selling_price"),
        F.when(F.col("total_orders") == 0, 0)
        .otherwise(int_divide(F.col("total_sales"), F.col("total_orders"))).alias("avg_order_revenue"),
        _per_month(F.col("total_sales"), lifespan).alias("avg_monthly_revenue"),
    )
