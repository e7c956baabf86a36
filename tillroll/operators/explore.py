"""Dimension, range, measure and magnitude exploration of the star tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.functions.dates import as_of_date, months_crossed, years_crossed
from tillroll.functions.numbers import int_divide, mean
from tillroll.operators.bitmaps import count_keys, key_bitmaps, number_of_keys
from tillroll.operators.totals import totals_by_dimension


# --- dimensions and ranges -----------------------------------------------------------------

def customer_countries(customers: DataFrame) -> DataFrame:
    return customers.select("country").distinct().orderBy("country")


def product_hierarchy(products: DataFrame) -> DataFrame:
    levels = ["category", "subcategory", "product_name"]
    return products.select(*levels).distinct().orderBy(*levels)


def order_date_range(fact: DataFrame) -> DataFrame:
    first, last = F.min("order_date"), F.max("order_date")
    return fact.agg(
        first.alias("first_order_date"),
        last.alias("last_order_date"),
        months_crossed(first, last).alias("order_range_months"),
    )


def birthdate_range(customers: DataFrame, as_of: dt.date | Column | None = None) -> DataFrame:
    oldest, youngest, today = F.min("birthdate"), F.max("birthdate"), as_of_date(as_of)
    return customers.agg(
        oldest.alias("oldest_birthdate"),
        years_crossed(oldest, today).alias("oldest_age"),
        youngest.alias("youngest_birthdate"),
        years_crossed(youngest, today).alias("youngest_age"),
    )


# --- single measures -----------------------------------------------------------------------

def total_sales(fact: DataFrame) -> DataFrame:
    return fact.agg(F.sum("sales_amount").alias("total_sales"))


def total_quantity(fact: DataFrame) -> DataFrame:
    return fact.agg(F.sum("quantity").alias("total_quantity"))


def average_price(fact: DataFrame, exact: bool = False) -> DataFrame:
    return fact.agg(mean(F.col("price"), exact).alias("avg_price"))


def order_lines(fact: DataFrame) -> DataFrame:
    return fact.agg(F.count("order_number").alias("total_orders"))


def distinct_orders(fact: DataFrame) -> DataFrame:
    return count_keys(fact, "order_number", "total_orders")


def product_count(products: DataFrame) -> DataFrame:
    return products.agg(F.count("product_name").alias("total_products"))


def customer_count(customers: DataFrame) -> DataFrame:
    return customers.agg(F.count("customer_key").alias("total_customers"))


def ordering_customers(fact: DataFrame) -> DataFrame:
    return count_keys(fact, "customer_key", "total_customers")


def key_metrics(fact: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """Six named measures; one scan per table, however many measures it feeds."""
    by_bucket = key_bitmaps(
        fact, "order_number", (), F.sum("sales_amount").alias("sales"), F.sum("quantity").alias("quantity"),
        F.sum("price").alias("price"), F.count("price").alias("prices"))
    sold = by_bucket.agg(
        F.sum("sales").alias("sales"),
        F.sum("quantity").alias("quantity"),
        int_divide(F.sum("price"), F.sum("prices")).alias("price"),
        number_of_keys().alias("orders"),
    ).selectExpr(
        "stack(4, 'Total Sales', sales, 'Total Quantity', quantity, "
        "'Average Price', price, 'Total Orders', orders) as (measure_name, measure_value)")
    listed = products.agg(F.count_distinct("product_name").alias("measure_value"))
    known = customers.agg(F.count("customer_key").alias("measure_value"))
    return sold.unionByName(
        listed.select(F.lit("Total Products").alias("measure_name"), "measure_value")
    ).unionByName(known.select(F.lit("Total Customers").alias("measure_name"), "measure_value"))


# --- magnitudes by dimension ---------------------------------------------------------------

def _largest_first(rows: DataFrame, measure: str) -> DataFrame:
    ties = [c for c in rows.columns if c != measure]
    return rows.orderBy(F.col(measure).desc_nulls_last(), *ties)


def customers_by(customers: DataFrame, attribute: str) -> DataFrame:
    counts = customers.groupBy(attribute).agg(F.count("customer_key").alias("total_customers"))
    return _largest_first(counts, "total_customers")


def customers_by_country(customers: DataFrame) -> DataFrame:
    return customers_by(customers, "country")


def customers_by_gender(customers: DataFrame) -> DataFrame:
    return customers_by(customers, "gender")


def products_by_category(products: DataFrame) -> DataFrame:
    counts = products.groupBy("category").agg(F.count("product_key").alias("total_products"))
    return _largest_first(counts, "total_products")


def average_cost_by_category(products: DataFrame, exact: bool = False) -> DataFrame:
    costs = products.groupBy("category").agg(mean(F.col("cost"), exact).alias("avg_cost"))
    return _largest_first(costs, "avg_cost")


def revenue_by_category(fact: DataFrame, products: DataFrame) -> DataFrame:
    revenue = totals_by_dimension(
        fact, products, "product_key", ["category"], total_revenue=(F.sum, "sales_amount"))
    return _largest_first(revenue, "total_revenue")


def customer_revenue(fact: DataFrame, customers: DataFrame) -> DataFrame:
    """Revenue per customer, unordered; the ranking operators sort or cut it."""
    return totals_by_dimension(
        fact, customers, "customer_key", ["customer_key", "first_name", "last_name"],
        total_revenue=(F.sum, "sales_amount"))


def revenue_by_customer(fact: DataFrame, customers: DataFrame) -> DataFrame:
    return _largest_first(customer_revenue(fact, customers), "total_revenue")


def items_by_country(fact: DataFrame, customers: DataFrame) -> DataFrame:
    sold = totals_by_dimension(
        fact, customers, "customer_key", ["country"], total_sold_items=(F.sum, "quantity"))
    return _largest_first(sold, "total_sold_items")
