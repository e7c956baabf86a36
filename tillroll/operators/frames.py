"""Aggregates behind the charts, over a (filtered) sales frame. Unknown keys are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.functions.numbers import percent, total
from tillroll.operators import labels
from tillroll.operators.bitmaps import key_bitmaps, number_of_keys

# Fixed value: a slice below this share of the total is small.
SMALL_SHARE = 0.10


def revenue_by(sales: DataFrame, *keys: str | Column) -> DataFrame:
    """Revenue per known key."""
    summed = sales.groupBy(*keys).agg(total(F.col("sales_amount")).alias("sales_amount"))
    return summed.dropna(subset=summed.columns[:-1])


def top_by_revenue(sales: DataFrame, key: str, n: int) -> DataFrame:
    """The n strongest keys; ties go to the first label."""
    return revenue_by(sales, key).orderBy(F.col("sales_amount").desc(), key).limit(n)


def monthly_trend(sales: DataFrame) -> DataFrame:
    return revenue_by(sales, "order_month").orderBy("order_month")


def yearly_revenue(sales: DataFrame) -> DataFrame:
    return revenue_by(sales, "order_year").orderBy("order_year")


def category_share(sales: DataFrame) -> DataFrame:
    """Category revenue, its share of the total and whether the slice is small."""
    by_category = revenue_by(sales, "category")
    overall = by_category.agg(F.sum("sales_amount").cast("double")).scalar()
    share = F.try_divide(F.col("sales_amount").cast("double"), overall)
    return by_category.withColumn("share", share).withColumn(
        "is_small", ~F.coalesce(F.col("share") >= SMALL_SHARE, F.lit(False))
    ).orderBy(F.col("sales_amount").desc(), "category")


def new_vs_returning(sales: DataFrame) -> DataFrame:
    buyer = F.when(F.col("is_returning"), "Returning").otherwise("New").alias("buyer")
    return revenue_by(sales, "order_year", buyer).orderBy("order_year", "buyer")


def revenue_by_calendar_month(sales: DataFrame) -> DataFrame:
    """All twelve months; one without sales has NULL revenue."""
    by_month = revenue_by(sales, F.month("order_date").alias("_month"))
    months = sales.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return months.join(by_month, F.col("month") == F.col("_month"), "left").select(
        "month", F.date_format(F.make_date(F.lit(2000), "month", F.lit(1)), "MMM").alias("month_name"),
        "sales_amount").orderBy("month")


def top_subcategories(sales: DataFrame, top_n: int = 8) -> DataFrame:
    return top_by_revenue(sales, "subcategory", top_n)


def margin_by_category(sales: DataFrame) -> DataFrame:
    """Margin in percent of the categories that earn anything, richest first."""
    return category_totals(sales).where(F.col("revenue") > 0).withColumn(
        "margin", percent(F.col("profit"), F.col("revenue"))
    ).orderBy(F.col("margin").desc(), "category")


def category_totals(sales: DataFrame) -> DataFrame:
    return sales.where(F.col("category").isNotNull()).groupBy("category").agg(
        total(F.col("sales_amount")).alias("revenue"), total(F.col("profit")).alias("profit"))


def top_products(sales: DataFrame, top_n: int = 10) -> DataFrame:
    return top_by_revenue(sales, "product_name", top_n)


def cost_segmentation(sales: DataFrame) -> DataFrame:
    """Products sold per cost band, every band present; an unknown cost is in none."""
    sold = sales.groupBy("product_key").agg(F.max("cost").alias("cost")).select(
        labels.sold_cost_band(F.col("cost")).alias("band"))
    counts = sold.agg(*[
        F.count_if(F.col("band") == band).alias(f"band_{i}") for i, band in enumerate(labels.COST_BANDS)])
    rows = F.array(*[
        F.struct(F.lit(band).alias("cost_range"), F.col(f"band_{i}").alias("products"))
        for i, band in enumerate(labels.COST_BANDS)])
    return counts.select(F.inline(rows))


def segment_split(sales: DataFrame) -> DataFrame:
    """Revenue and distinct customers by segment; the customers as bitmaps, not as keys."""
    by_bucket = key_bitmaps(sales.where(F.col("customer_segment").isNotNull()), "customer_key", ["customer_segment"],
                            F.sum("sales_amount").alias("sales_amount"))
    return by_bucket.groupBy("customer_segment").agg(
        total(F.col("sales_amount")).alias("revenue"),
        number_of_keys().alias("customers"),
    ).orderBy("customer_segment")


def age_groups(sales: DataFrame) -> DataFrame:
    return revenue_by(sales, "age_group").orderBy("age_group")


def top_countries(sales: DataFrame, top_n: int = 10) -> DataFrame:
    return top_by_revenue(sales, "country", top_n)
