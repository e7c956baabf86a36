"""Change over time, running totals and year-over-year performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tillroll.functions.dates import month_start, year_start
from tillroll.functions.numbers import int_divide, mean, percent
from tillroll.operators.totals import totals_by_dimension


def _dated(fact: DataFrame) -> DataFrame:
    return fact.where(F.col("order_date").isNotNull())


def _activity(fact: DataFrame, **periods: Column) -> DataFrame:
    """Sales, distinct customers and quantity per period."""
    named = [c.alias(f"_{name}") for name, c in periods.items()]
    rows = _dated(fact).select(*named, "sales_amount", "customer_key", "quantity")
    keys = [f"_{name}" for name in periods]
    return rows.groupBy(*keys).agg(
        F.sum("sales_amount").alias("total_sales"),
        F.count_distinct("customer_key").alias("total_customers"),
        F.sum("quantity").alias("total_quantity"),
    ).withColumnsRenamed({f"_{name}": name for name in periods}).orderBy(*periods)


def activity_by_year_month(fact: DataFrame) -> DataFrame:
    return _activity(fact, order_year=F.year("order_date"), order_month=F.month("order_date"))


def activity_by_month_start(fact: DataFrame) -> DataFrame:
    return _activity(fact, order_date=month_start(F.col("order_date")))


def activity_by_month_text(fact: DataFrame) -> DataFrame:
    """Months as ``yyyy-MMM`` text, grouped and sorted as text (Apr before Jan)."""
    return _activity(fact, order_date=F.date_format("order_date", "yyyy-MMM"))


def _windowed_mean(c: str, window: WindowSpec, exact: bool) -> Column:
    if exact:
        return F.avg(c).over(window)
    return int_divide(F.sum(c).over(window), F.count(c).over(window))


def running_totals(fact: DataFrame, grain: str = "year", exact: bool = False) -> DataFrame:
    """Sales per period with their running total and the running mean of the mean price.

    The windows run over one row per period, so the single task they need stays small.
    ``exact`` gives double means instead of integer ones.
    """
    start = {"year": year_start, "month": month_start}[grain]
    per_period = _dated(fact).select(
        start(F.col("order_date")).alias("_period"), "sales_amount", "price"
    ).groupBy("_period").agg(
        F.sum("sales_amount").alias("total_sales"), mean(F.col("price"), exact).alias("_avg_price"))
    so_far = Window.orderBy("_period")
    return per_period.select(
        F.col("_period").alias("order_date"),
        "total_sales",
        F.sum("total_sales").over(so_far).alias("running_total_sales"),
        _windowed_mean("_avg_price", so_far, exact).alias("moving_average_price"),
    )


def _direction(difference: Column, up: str, down: str, same: str) -> Column:
    return F.when(difference > 0, up).when(difference < 0, down).otherwise(same)


def product_performance(fact: DataFrame, products: DataFrame, exact: bool = False) -> DataFrame:
    """Yearly sales per product name against its mean year and its previous sold year."""
    yearly = _dated(fact).select(
        F.year("order_date").alias("order_year"), "product_key", "sales_amount"
    ).groupBy("order_year", "product_key").agg(F.sum("sales_amount").alias("current_sales"))
    names = products.select("product_key", "product_name")
    by_name = yearly.join(names, "product_key", "left").groupBy("order_year", "product_name").agg(
        F.sum("current_sales").alias("current_sales"))

    same_product = Window.partitionBy("product_name")
    compared = by_name.withColumns({
        "avg_sales": _windowed_mean("current_sales", same_product, exact),
        "py_sales": F.lag("current_sales").over(same_product.orderBy("order_year")),
    }).withColumns({
        "diff_avg": F.col("current_sales") - F.col("avg_sales"),
        "diff_py": F.col("current_sales") - F.col("py_sales"),
    })
    return compared.select(
        "order_year", "product_name", "current_sales", "avg_sales", "diff_avg",
        _direction(F.col("diff_avg"), "Above Avg", "Below Avg", "Avg").alias("avg_change"),
        "py_sales", "diff_py",
        _direction(F.col("diff_py"), "Increase", "Decrease", "No Change").alias("py_change"),
    ).orderBy("product_name", "order_year")


def category_shares(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Category sales and their share of all sales in percent, two places.

    The overall total is a scalar subquery, so categories need no common task.
    """
    by_category = totals_by_dimension(
        fact, products, "product_key", ["category"], total_sales=(F.sum, "sales_amount"))
    overall = by_category.agg(F.sum("total_sales")).scalar()
    return by_category.withColumn("overall_sales", overall).withColumn(
        "percentage_of_total", F.round(percent(F.col("total_sales"), F.col("overall_sales")), 2)
    ).orderBy(F.col("total_sales").desc_nulls_last(), "category")
