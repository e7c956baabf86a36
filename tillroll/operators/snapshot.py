"""Aggregate snapshot of a (filtered) sales frame, free of personal data.

Only the groupings named here can appear: no customer, order or date column reaches a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillroll.functions.numbers import percent
from tillroll.functions.text import grouped_number, plain_number
from tillroll.operators import frames
from tillroll.operators.insights import kpis, kpis_of, report_parts

TOP_N = 5
GROUPINGS = ("category", "customer_segment", "order_year", "country", "product_name")

# The wording of the rendered snapshot. %s marks a figure or label.
NO_DATA = "No data in the current filter."
HEADING = "DATA SNAPSHOT (current dashboard filter; all figures in EUR):"
MONEY_LINE = "- Revenue: %s; Gross profit: %s (%s%% margin)"
COUNT_LINE = "- Orders: %s; Customers: %s; Units: %s; Avg order value: %s"
CATEGORY_HEADING = "- Revenue & margin by category:"
CATEGORY_LINE = "    %s: %s (%s%% margin)"
SEGMENT_HEADING = "- By customer segment (revenue / #customers):"
SEGMENT_LINE = "    %s: %s / %s"
YEAR_LABEL = "Revenue by year"
COUNTRY_LABEL = "Top countries"
PRODUCT_LABEL = "Top products"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Rows numbered in order; only for rows already reduced to a handful of groups."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def kpi_figures(sales: DataFrame) -> DataFrame:
    return kpis(sales).drop("items_per_order")


def category_figures(sales: DataFrame) -> DataFrame:
    """Revenue and margin per category, strongest first; no revenue means margin 0."""
    margin = F.coalesce(percent(F.col("profit"), F.col("revenue")), F.lit(0.0))
    by_category = frames.category_totals(sales).select("category", "revenue", margin.alias("margin"))
    return _ranked(by_category, F.col("revenue").desc(), "category")


def segment_figures(sales: DataFrame) -> DataFrame:
    return _ranked(frames.segment_split(sales), F.col("revenue").desc(), "customer_segment")


def year_figures(sales: DataFrame) -> DataFrame:
    return _ranked(frames.revenue_by(sales, "order_year"), "order_year")


def top_figures(sales: DataFrame, column: str, n: int = TOP_N) -> DataFrame:
    if column not in GROUPINGS:
        raise ValueError(f"{column} may not appear in a snapshot")
    return _ranked(frames.top_by_revenue(sales, column, n), F.col("sales_amount").desc(), column)


def _long(rows: DataFrame, section: str, key: Column, **metrics: str) -> DataFrame:
    """One output row per group and metric."""
    figures = F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("value"))
        for name, c in metrics.items()])
    return rows.select(
        F.lit(section).alias("section"), F.col("rank"), key.cast("string").alias("key"), F.inline(figures))


def _headline_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """The KPI rows, or the one row that says there is nothing to report."""
    headline = kpis_of(parts)
    metrics = [c for c in headline.columns if c not in ("items_per_order", "lines")]

    def entry(section: str, key: str | None, metric: str | None, value: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), F.lit(1).alias("rank"),
            F.lit(key).cast("string").alias("key"), F.lit(metric).cast("string").alias("metric"),
            value.cast("double").alias("value"))

    figures = F.array(*[entry("kpi", None, m, F.col(m)) for m in metrics])
    nothing = F.array(entry("no_data", NO_DATA, None, F.lit(None)))
    return headline.select(F.inline(F.when(F.col("lines") > 0, figures).otherwise(nothing)))


def snapshot(sales: DataFrame) -> DataFrame:
    """Rows of (section, rank, key, metric, value); one ``no_data`` row for an empty frame."""
    return snapshot_of(report_parts(sales))


def snapshot_of(parts: dict[str, DataFrame]) -> DataFrame:
    """The snapshot from the report parts of a frame or of star tables."""
    products, customers = parts["products"], parts["customers"]
    return _union([
        _headline_rows(parts),
        _long(category_figures(products), "category", F.col("category"), revenue="revenue", margin="margin"),
        _long(segment_figures(customers), "segment", F.col("customer_segment"),
              revenue="revenue", customers="customers"),
        _long(year_figures(customers), "year", F.col("order_year"), revenue="sales_amount"),
        _long(top_figures(customers, "country"), "top_countries", F.col("country"), revenue="sales_amount"),
        _long(top_figures(products, "product_name"), "top_products", F.col("product_name"), revenue="sales_amount"),
    ])


# --- rendered text -------------------------------------------------------------------------

def _texts(rows: DataFrame, section: int, text: Column) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), F.col("rank"), text.alias("line"))


def _headings(parts: dict[str, DataFrame]) -> DataFrame:
    """The lines every snapshot has, as rank 0 of their section; or only the no-data line."""
    money = F.format_string(
        MONEY_LINE, grouped_number(F.col("revenue")), grouped_number(F.col("profit")),
        plain_number(F.col("margin"), 1))
    counts = F.format_string(
        COUNT_LINE, *[grouped_number(F.col(c)) for c in ("orders", "customers", "units", "aov")])

    def entry(section: int, rank: int, line: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(rank).alias("rank"), line.alias("line"))

    texts = F.array(
        entry(0, 0, F.lit(HEADING)), entry(0, 1, money), entry(0, 2, counts),
        entry(1, 0, F.lit(CATEGORY_HEADING)), entry(2, 0, F.lit(SEGMENT_HEADING)),
        entry(3, 0, F.lit(YEAR_LABEL)), entry(4, 0, F.lit(COUNTRY_LABEL)), entry(5, 0, F.lit(PRODUCT_LABEL)))
    nothing = F.array(entry(0, 0, F.lit(NO_DATA)))
    return kpis_of(parts).select(F.inline(F.when(F.col("lines") > 0, texts).otherwise(nothing)))


def snapshot_lines(sales: DataFrame) -> DataFrame:
    """The snapshot as text, one row per line, ordered by (section, rank)."""
    return lines_of(report_parts(sales))


def lines_of(parts: dict[str, DataFrame]) -> DataFrame:
    """The snapshot's text from the report parts of a frame or of star tables."""
    products, customers = parts["products"], parts["customers"]
    category = F.format_string(
        CATEGORY_LINE, F.col("category"), grouped_number(F.col("revenue")), plain_number(F.col("margin"), 0))
    segment = F.format_string(
        SEGMENT_LINE, F.col("customer_segment"), grouped_number(F.col("revenue")),
        grouped_number(F.col("customers")))

    def figure(key: str) -> Column:
        return F.concat(F.col(key).cast("string"), F.lit(": "), grouped_number(F.col("sales_amount")))

    headings = _headings(parts)
    # sections 3 to 5 are one line each: the label and a handful of figures in rank order
    pieces = _union([
        headings.where(F.col("section") >= 3),
        _texts(year_figures(customers), 3, figure("order_year")),
        _texts(top_figures(customers, "country"), 4, figure("country")),
        _texts(top_figures(products, "product_name"), 5, figure("product_name")),
    ])
    ordered = F.array_sort(F.collect_list(F.struct("rank", "line")))
    gathered = pieces.groupBy("section").agg(ordered.alias("parts")).select(
        "section", F.col("parts.line").alias("parts"))
    joined = gathered.select(
        "section", F.lit(0).alias("rank"),
        F.concat(F.lit("- "), F.col("parts")[0], F.lit(": "),
                 F.array_join(F.slice("parts", F.lit(2), F.size("parts")), ", ")).alias("line"))
    return _union([
        headings.where(F.col("section") < 3),
        _texts(category_figures(products), 1, category),
        _texts(segment_figures(customers), 2, segment),
        joined,
    ]).orderBy("section", "rank")
