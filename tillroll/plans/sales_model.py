"""The denormalised sales frame and its filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillroll import schemas
from tillroll.functions.dates import as_of_date, month_start, months_crossed, years_crossed
from tillroll.operators import labels

SALES_COLUMNS = tuple(schemas.SALES.fieldNames())
_FROM_PRODUCTS = ("product_name", "category", "subcategory", "cost")
_FROM_CUSTOMERS = ("country", "gender", "marital_status")
_FROM_SEGMENTS = ("customer_segment", "age_group")


def line_profit() -> Column:
    """Sales amount less unit cost × quantity; NULL when the cost is unknown."""
    return F.col("sales_amount") - F.col("cost") * F.col("quantity")


def with_periods(dated: DataFrame) -> DataFrame:
    return dated.withColumns({
        "order_month": month_start(F.col("order_date")),
        "order_year": F.year("order_date"),
    })


def customer_profile(
    dated: DataFrame,
    customers: DataFrame,
    segments: DataFrame | None,
    as_of: dt.date | Column | None,
    wanted: set[str],
    segment_months: int,
    segment_spend: int,
) -> DataFrame:
    """Per ordering customer: first order year, dimension attributes and segment labels.

    One aggregation by customer serves the returning flag and, when no saved report is
    given, the segment as well.
    """
    profile = dated.where(F.col("customer_key").isNotNull()).groupBy("customer_key").agg(
        F.min("order_date").alias("_first"),
        F.max("order_date").alias("_last"),
        F.sum("sales_amount").alias("_spend"),
    ).withColumn("_first_year", F.year("_first"))
    derive = segments is None and bool(wanted & set(_FROM_SEGMENTS))
    if derive or wanted & set(_FROM_CUSTOMERS):
        known = customers.select("customer_key", *_FROM_CUSTOMERS, "birthdate", F.lit(True).alias("_known"))
        profile = profile.join(known, "customer_key", "left")
    if derive:
        age = years_crossed(F.col("birthdate"), as_of_date(as_of))
        segment = labels.customer_segment(
            months_crossed(F.col("_first"), F.col("_last")), F.col("_spend"), segment_months, segment_spend)
        profile = profile.withColumns({
            "customer_segment": F.when(F.col("_known"), segment),
            "age_group": F.when(F.col("_known"), labels.age_group(age)),
        })
    elif wanted & set(_FROM_SEGMENTS):
        profile = profile.join(segments.select("customer_key", *_FROM_SEGMENTS), "customer_key", "left")
    kept = [c for c in (*_FROM_CUSTOMERS, *_FROM_SEGMENTS) if c in wanted]
    return profile.select("customer_key", "_first_year", *kept)


def build_sales(
    fact: DataFrame,
    products: DataFrame,
    customers: DataFrame,
    segments: DataFrame | None = None,
    *,
    as_of: dt.date | Column | None = None,
    columns: Sequence[str] | None = None,
    segment_months: int = labels.SEGMENT_MONTHS,
    segment_spend: int = labels.SEGMENT_SPEND,
    co_located: bool = False,
) -> DataFrame:
    """Dated sales lines with product, customer and segment attributes.

    ``segments`` is a saved customer report; without one the labels are derived here, so they
    are never stale. ``columns`` names the columns the caller needs: a lookup nobody asked
    for is not joined. Build the frame before filtering it, since the returning flag looks at
    a customer's whole history, and save or persist it when many reports run on it.

    The profile is grouped by customer. Joined on that key its partitions would be taken as they
    are, and adaptive execution could not split a hot customer, or the lines without one. Both
    sides therefore join on an image of the key: each is shuffled for the join alone, whatever
    the number of lines per key. ``co_located`` says that the lines are stored in buckets by
    customer without hot ones (`plans.co_located`): then the join takes the buckets as they are.
    """
    wanted = set(columns or SALES_COLUMNS)
    dated = fact.where(F.col("order_date").isNotNull())
    sales = with_periods(dated)
    def with_products(sales: DataFrame) -> DataFrame:
        if not wanted & {*_FROM_PRODUCTS, "profit"}:
            return sales
        found = sales.join(products.select("product_key", *_FROM_PRODUCTS), "product_key", "left")
        return found.withColumn("profit", line_profit())

    sales = sales if co_located else with_products(sales)
    if wanted & {*_FROM_CUSTOMERS, *_FROM_SEGMENTS, "is_returning"}:
        profile = customer_profile(
            dated, customers, segments, as_of, wanted, segment_months, segment_spend)
        if co_located:
            profile = profile.withColumnRenamed("customer_key", "_join_key").hint("merge")
            sales = sales.join(profile, F.col("customer_key") == F.col("_join_key"), "left")
        else:
            profile = profile.withColumn("_join_key", F.bitwise_not("customer_key")).drop("customer_key")
            sales = sales.withColumn("_join_key", F.bitwise_not("customer_key")).join(profile, "_join_key", "left")
        sales = sales.withColumn(
            "is_returning", F.coalesce(F.col("order_year") > F.col("_first_year"), F.lit(False)))
    # a product join shuffles the lines by product, so those in buckets meet their customers first
    sales = with_products(sales) if co_located else sales
    return sales.select(*[c for c in SALES_COLUMNS if c in wanted])


def filter_options(sales: DataFrame) -> DataFrame:
    """Values a filter can take, one row each: the date span and every known label.

    One aggregation by the three labels; only its few rows are unfolded. The span rows stand even
    for an empty frame.
    """
    fields = ("category", "country", "customer_segment")
    combined = sales.groupBy(*fields).agg(
        F.min("order_date").alias("min_date"), F.max("order_date").alias("max_date"))
    entries = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
        for f in (*fields, "min_date", "max_date")])
    order = F.array_position(F.array(F.lit("min_date"), F.lit("max_date")), F.col("field"))
    # the two span rows of an empty frame
    spans = sales.sparkSession.createDataFrame([("min_date",), ("max_date",)], "field string").select(
        "field", F.lit(None).cast("string").alias("value"))
    unfolded = combined.select(F.inline(entries)).unionByName(spans)
    label = ~F.col("field").isin("min_date", "max_date")
    return (
        unfolded.where(~label | F.col("value").isNotNull())
        .groupBy("field", F.when(label, F.col("value")).alias("_label"))
        .agg(F.when(F.col("field") == "max_date", F.max("value")).otherwise(F.min("value")).alias("value"))
        .orderBy(F.when(order == 0, 3).otherwise(order), "field", "value").select("field", "value"))


def apply_filters(
    sales: DataFrame,
    date_range: Sequence[dt.date | str | None] | None = None,
    categories: Iterable[str] = (),
    countries: Iterable[str] = (),
    segments: Iterable[str] = (),
) -> DataFrame:
    """Keep lines inside the inclusive date range and the listed labels.

    An empty list, or a range without two set ends, restricts nothing; NULL is in no list.
    """
    out = sales
    if date_range and len(date_range) == 2 and all(date_range):
        start, end = (F.lit(d).cast("date") for d in date_range)
        out = out.where(F.col("order_date").between(start, end))
    for column, allowed in (
        ("category", categories), ("country", countries), ("customer_segment", segments)
    ):
        allowed = list(allowed or ())
        if allowed:
            out = out.where(F.col(column).isin(allowed))
    return out


def date_slice(fact: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Lines of an inclusive date range from a fact stored by order year: only its years' folders are read,
    and in these, sorted by date, only the row groups that meet the range."""
    return apply_filters(fact.where(F.col("order_year").between(start.year, end.year)), (start, end))
