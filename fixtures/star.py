"""The star schema over the generated test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = dt.date(2001, 12, 31)
HIGH_SPEND = 2_000_000

_FACT = ("order_number", "product_key", "customer_key", "order_date", "shipping_date", "due_date",
         "sales_amount", "quantity", "price")
_FROM_ORDERS = {"customer_key", "order_date", "due_date"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact_sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Sales lines; orders are only joined when one of the columns comes from them."""
    wanted = columns or _FACT
    lines = table(spark, sf_dir, "lineitem")
    if _FROM_ORDERS & set(wanted):
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        lines = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left")
        undated = F.col("l_orderkey") % 97 == 0
        lines = lines.withColumns({
            "customer_key": F.col("o_custkey"),
            "order_date": F.when(~undated, F.col("o_orderdate").cast("date")),
            "due_date": F.date_add(F.col("o_orderdate").cast("date"), 12),
        })
    lines = lines.withColumns({
        "order_number": F.col("l_orderkey").cast("string"),
        "product_key": F.col("l_partkey"),
        "shipping_date": F.col("l_shipdate").cast("date"),
        "sales_amount": F.round("l_extendedprice").cast("bigint"),
        "quantity": F.col("l_quantity").cast("bigint"),
    }).withColumn("price", F.expr("sales_amount div quantity"))
    return lines.select(*wanted)


def dirty_fact_sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Sales lines with NULL customer keys and dangling product and customer keys."""
    wanted = columns or _FACT
    fact = fact_sales(spark, sf_dir, *_FACT)
    order = F.col("order_number").cast("bigint")
    return fact.withColumns({
        "customer_key": F.when(order % 89 == 0, None)
        .when(order % 79 == 0, F.col("customer_key") + 1_000_000_000)
        .otherwise(F.col("customer_key")),
        "product_key": F.when(order % 83 == 0, F.col("product_key") + 1_000_000_000)
        .otherwise(F.col("product_key")),
    }).select(*wanted)


def dim_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("c_custkey")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").select(
        key.alias("customer_key"),
        key.alias("customer_id"),
        F.col("c_name").alias("customer_number"),
        F.when(key % 53 != 0, "First").alias("first_name"),
        F.col("c_name").alias("last_name"),
        F.col("n_name").alias("country"),
        F.when(key % 2 == 0, "Married").otherwise("Single").alias("marital_status"),
        F.when(key % 3 == 0, "Male").when(key % 3 == 1, "Female").otherwise("n/a").alias("gender"),
        F.when(key % 41 != 0, F.date_add(F.lit(dt.date(1940, 1, 1)), ((key * 37) % 25000).cast("int")))
        .alias("birthdate"),
        F.lit(dt.date(2000, 1, 1)).alias("create_date"),
    )


def dim_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("product_key"),
        key.alias("product_id"),
        key.cast("string").alias("product_number"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("category_id"),
        F.when(key % 43 != 0, F.col("p_type")).alias("category"),
        F.col("p_brand").alias("subcategory"),
        F.lit("Yes").alias("maintenance"),
        F.when(key % 61 != 0, F.col("p_size").cast("bigint") * 25).alias("cost"),
        F.lit("Road").alias("product_line"),
        F.lit(dt.date(1995, 1, 1)).alias("start_date"),
    )


# The same tables for DuckDB. Common table expressions nobody reads cost nothing there.
SQL = """
fact_sales AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_number,
         l_partkey AS product_key,
         o_custkey AS customer_key,
         CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS order_date,
         CAST(l_shipdate AS DATE) AS shipping_date,
         CAST(o_orderdate AS DATE) + 12 AS due_date,
         CAST(round(l_extendedprice) AS BIGINT) AS sales_amount,
         CAST(l_quantity AS BIGINT) AS quantity,
         CAST(round(l_extendedprice) AS BIGINT) // CAST(l_quantity AS BIGINT) AS price
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
),
dirty_fact_sales AS (
  SELECT order_number,
         CASE WHEN CAST(order_number AS BIGINT) % 83 = 0 THEN product_key + 1000000000
              ELSE product_key END AS product_key,
         CASE WHEN CAST(order_number AS BIGINT) % 89 = 0 THEN NULL
              WHEN CAST(order_number AS BIGINT) % 79 = 0 THEN customer_key + 1000000000
              ELSE customer_key END AS customer_key,
         order_date, shipping_date, due_date, sales_amount, quantity, price
  FROM fact_sales
),
dim_customers AS (
  SELECT c_custkey AS customer_key, c_custkey AS customer_id, c_name AS customer_number,
         CASE WHEN c_custkey % 53 = 0 THEN NULL ELSE 'First' END AS first_name,
         c_name AS last_name, n_name AS country,
         CASE WHEN c_custkey % 2 = 0 THEN 'Married' ELSE 'Single' END AS marital_status,
         CASE c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'n/a' END AS gender,
         CASE WHEN c_custkey % 41 = 0 THEN NULL
              ELSE DATE '1940-01-01' + CAST((c_custkey * 37) % 25000 AS INTEGER) END AS birthdate,
         DATE '2000-01-01' AS create_date
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
),
dim_products AS (
  SELECT p_partkey AS product_key, p_partkey AS product_id,
         CAST(p_partkey AS VARCHAR) AS product_number, p_name AS product_name,
         p_brand AS category_id,
         CASE WHEN p_partkey % 43 = 0 THEN NULL ELSE p_type END AS category,
         p_brand AS subcategory, 'Yes' AS maintenance,
         CASE WHEN p_partkey % 61 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) * 25 END AS cost,
         'Road' AS product_line, DATE '1995-01-01' AS start_date
  FROM part
)"""
