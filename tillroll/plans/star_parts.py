"""Report parts straight from the star tables: lines are reduced by key before any lookup.

Cards and snapshot need three tables: sums by product, sums by customer and month, and the order
numbers as bitmaps. Each is reduced from the lines alone, so it reads the columns of its own keys and
sends a row per key. Products and customers are looked up afterwards, in rows that no longer grow
with the lines. Only a filter on a label needs a lookup of lines, one for the side it names.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.operators import labels
from tillroll.operators.bitmaps import key_bitmaps, key_spans
from tillroll.plans.sales_model import apply_filters, customer_profile

LINE_COLUMNS = ("product_key", "customer_key", "order_number", "order_date", "sales_amount", "quantity")
_PROFILE = {"country", "customer_segment"}


def profile_of(
    dated: DataFrame, customers: DataFrame, as_of: dt.date | Column | None = None,
    segment_months: int = labels.SEGMENT_MONTHS, segment_spend: int = labels.SEGMENT_SPEND,
) -> DataFrame:
    """Country, segment and first year of each ordering customer, from dated lines or sums by month."""
    return customer_profile(dated, customers, None, as_of, _PROFILE, segment_months, segment_spend)


def star_lines(
    fact: DataFrame, products: DataFrame, profile: DataFrame,
    date_range: Sequence[dt.date | str | None] | None = None,
    categories: Iterable[str] = (), countries: Iterable[str] = (), segments: Iterable[str] = (),
) -> DataFrame:
    """The narrow dated lines a filter lets through; see ``apply_filters`` for its meaning.

    Lines meet the products only if categories are named, and the customers' profile only if
    countries or segments are. Store the result when it is filtered: three parts read it.
    """
    categories, countries, segments = list(categories), list(countries), list(segments)
    lines = apply_filters(fact.where(F.col("order_date").isNotNull()).select(*LINE_COLUMNS), date_range)
    if categories:
        kept = apply_filters(products, categories=categories).select("product_key")
        lines = lines.join(kept, "product_key", "left_semi")
    if countries or segments:
        kept = apply_filters(profile, countries=countries, segments=segments).select("customer_key")
        lines = lines.join(kept, "customer_key", "left_semi")
    return lines


def product_part(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Sums by product and category, the lines summed by key first.

    A line's profit counts if amount, quantity and cost are known: amount and quantity of the lines
    that have both are summed beside, and the cost enters with the product.
    """
    both = F.col("sales_amount").isNotNull() & F.col("quantity").isNotNull()
    by_key = lines.groupBy("product_key").agg(
        F.sum("sales_amount").alias("sales_amount"), F.sum("quantity").alias("quantity"),
        F.sum(F.when(both, F.col("sales_amount"))).alias("_sold"),
        F.sum(F.when(both, F.col("quantity"))).alias("_units"), F.count("*").alias("lines"))
    known = products.select("product_key", "product_name", "category", "cost")
    profit = F.col("_sold") - F.col("cost") * F.col("_units")
    return by_key.join(known, "product_key", "left").withColumn("profit", profit).groupBy(
        "product_name", "category").agg(
        *[F.sum(c).alias(c) for c in ("sales_amount", "profit", "quantity", "lines")])


def customer_months(lines: DataFrame) -> DataFrame:
    """Sums by customer and month, with the first and the last order."""
    return key_spans(lines, "order_number", ["customer_key", F.trunc("order_date", "MM").alias("order_date")],
                     F.sum("sales_amount").alias("sales_amount"), F.count("*").alias("lines"))


def customer_part(months: DataFrame, profile: DataFrame) -> DataFrame:
    """`customer_months` with the customers' labels, the year and the returning flag."""
    year = F.year("order_date")
    return months.join(profile, "customer_key", "left").select(
        *months.columns, *sorted(_PROFILE), year.alias("order_year"),
        F.coalesce(year > F.col("_first_year"), F.lit(False)).alias("is_returning"))


def order_part(lines: DataFrame) -> DataFrame:
    """The order numbers as bitmaps."""
    return key_bitmaps(lines, "order_number")


def headline_parts(lines: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """What the headline figures need: no customer is looked up."""
    return {"products": product_part(lines, products), "customers": lines.select("customer_key"),
            "orders": order_part(lines)}
