"""Products per cost band and customers per segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillroll.functions.dates import months_crossed
from tillroll.operators import labels
from tillroll.operators.totals import totals_by_dimension


def products_by_cost_band(products: DataFrame, limits: tuple = labels.COST_LIMITS) -> DataFrame:
    """Every catalogue product by cost band; an unknown cost counts in the last band."""
    band = labels.catalogue_cost_band(F.col("cost"), limits).alias("cost_range")
    return products.select(band, "product_key").groupBy("cost_range").agg(
        F.count("product_key").alias("total_products")
    ).orderBy(F.col("total_products").desc(), "cost_range")


def customers_by_segment(
    fact: DataFrame,
    customers: DataFrame,
    months: int = labels.SEGMENT_MONTHS,
    limit: int = labels.SEGMENT_SPEND,
) -> DataFrame:
    """Customers per spending segment, undated lines included in the spend."""
    spending = totals_by_dimension(
        fact, customers, "customer_key", ["customer_key"],
        spend=(F.sum, "sales_amount"), first=(F.min, "order_date"), last=(F.max, "order_date"),
    )
    segment = labels.customer_segment(
        months_crossed(F.col("first"), F.col("last")), F.col("spend"), months, limit)
    return spending.select(segment.alias("customer_segment"), "customer_key").groupBy(
        "customer_segment").agg(F.count("customer_key").alias("total_customers")
    ).orderBy(F.col("total_customers").desc(), "customer_segment")
