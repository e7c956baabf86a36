"""Raw, dirty extracts derived from the whole test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fixtures.star import table

NBSP = "\xa0"


def _every(key: Column, n: int) -> Column:
    return key % n == 0


def _compact(date: Column) -> Column:
    return F.replace(date.cast("string"), F.lit("-"), F.lit(""))


def _copies(*extra: Column) -> Column:
    """One array entry for the row itself and one for each further copy it gets."""
    return F.explode(F.filter(F.array(F.lit(0), *extra), lambda v: v.isNotNull()))


def crm_sales_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    key, qty = F.col("l_orderkey"), F.col("l_quantity").cast("bigint")
    price = F.expr("cast(round(l_extendedprice) as bigint) div cast(l_quantity as bigint)")
    ordered = F.col("o_orderdate").cast("date")
    return lines.join(orders, key == F.col("o_orderkey"), "left").select(
        key.cast("string").alias("sls_ord_num"),
        F.col("l_partkey").cast("string").alias("sls_prd_key"),
        F.when(_every(key, 109), "unknown")
        .when(_every(key, 113), F.concat(F.col("o_custkey").cast("string"), F.lit(".0")))
        .otherwise(F.col("o_custkey").cast("string")).alias("sls_cust_id"),
        F.when(_every(key, 101), "0").when(_every(key, 103), "2013").when(_every(key, 107), "20130230")
        .otherwise(F.concat(F.lit(" "), _compact(ordered))).alias("sls_order_dt"),
        _compact(F.col("l_shipdate").cast("date")).alias("sls_ship_dt"),
        _compact(F.date_add(ordered, 12)).alias("sls_due_dt"),
        F.when(_every(key, 131), "15").when(_every(key, 11), "").when(_every(key, 13), "999999")
        .otherwise((qty * price).cast("string")).alias("sls_sales"),
        F.when(_every(key, 131), "1.5").when(_every(key, 127), "0").otherwise(qty.cast("string")).alias("sls_quantity"),
        F.when(_every(key, 131), "10").when(_every(key, 17), (-price).cast("string")).when(_every(key, 19), "")
        .otherwise(price.cast("string")).alias("sls_price"),
    )


def crm_cust_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current rows, older copies of some and id-less copies of others."""
    key = F.col("c_custkey")
    copies = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name",
        _copies(F.when(_every(key, 5), 1), F.when(_every(key, 31), 2)).alias("copy"))
    older, nameless = F.col("copy") == 1, F.col("copy") == 2
    code = key % 4
    return copies.select(
        F.when(nameless, "  ").otherwise(F.concat(F.lit(" "), key.cast("string"))).alias("cst_id"),
        F.concat(F.lit("AW"), F.lpad(key.cast("string"), 10, "0")).alias("cst_key"),
        F.concat(F.lit("\t"), F.when(older, "Old").otherwise("New"), F.lit(NBSP)).alias("cst_firstname"),
        F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("cst_lastname"),
        F.when(code == 0, "M").when(code == 1, " s").when(code == 2, "S ").otherwise("").alias("cst_marital_status"),
        F.when(code == 0, "m").when(code == 1, " F ").when(code == 2, "X").otherwise("").alias("cst_gndr"),
        F.when(older & _every(key, 29), "someday").when(older, "2020-01-31").otherwise("2025-10-06")
        .alias("cst_create_date"),
    )


def _product_code() -> Column:
    return F.concat(
        F.upper(F.substring("p_type", 1, 2)), F.lit("-"),
        F.lpad(F.regexp_replace("p_brand", "^Brand#", ""), 2, "0"))


def crm_prd_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current versions, older ones of some products, and undated ones of a few."""
    key = F.col("p_partkey")
    versions = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_type", "p_brand", "p_size",
        _copies(F.when(_every(key, 4), 1), F.when(_every(key, 37), 2)).alias("copy"))
    copy, line = F.col("copy"), key % 5
    return versions.select(
        (key * 3 + copy).cast("string").alias("prd_id"),
        F.concat(_product_code(), F.lit("-"), key.cast("string")).alias("prd_key"),
        F.concat(F.lit(" "), "p_name", F.when(copy > 0, " (v").otherwise(""),
                 F.when(copy > 0, copy.cast("string")).otherwise(""), F.lit(NBSP)).alias("prd_nm"),
        F.when(_every(key, 7), "").when(_every(key, 23), "12.75")
        .otherwise((F.col("p_size") * 25).cast("string")).alias("prd_cost"),
        F.when(line == 0, "R ").when(line == 1, "m").when(line == 2, "S").when(line == 3, " t ")
        .otherwise("").alias("prd_line"),
        F.when(copy == 0, "2013-07-01").when(copy == 1, "2011-07-01").otherwise("").alias("prd_start_dt"),
        F.when(copy == 1, "2007-12-28").otherwise("").alias("prd_end_dt"),
    )


def erp_cust_az12(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    code, number = key % 5, F.lpad(key.cast("string"), 10, "0")
    born = F.date_add(F.lit("1940-01-01").cast("date"), ((key * 37) % 25000).cast("int"))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.when(key % 2 == 0, "NAS").otherwise(""), F.lit("AW"), number, F.lit(" ")).alias("cid"),
        F.when(_every(key, 47), "2999-01-01").when(_every(key, 59), "soon")
        .when(_every(key, 61), "2002-03-04").otherwise(born.cast("string")).alias("bdate"),
        F.when(code == 0, "F").when(code == 1, "FEMALE").when(code == 2, "m ").when(code == 3, "male")
        .otherwise("").alias("gen"),
    )


def erp_loc_a101(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("c_custkey")
    code = key % 9
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.concat(F.lit("AW-"), F.lpad(key.cast("string"), 10, "0")).alias("cid"),
        F.when(code == 0, "DE").when(code == 1, "US ").when(code == 2, "USA").when(code == 3, "us")
        .when(code == 4, "").when(code == 5, NBSP)
        .otherwise(F.concat(F.lit(" "), "n_name", F.lit(" "))).alias("cntry"),
    )


def erp_px_cat_g1v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One padded row per category id of the parts; the first id is missing."""
    parts = table(spark, sf_dir, "part")
    code = F.translate(_product_code(), "-", "_")
    ids = parts.groupBy(code.alias("id"), "p_type", "p_brand").agg(F.count("*").alias("_n"))
    return ids.where(F.col("id") != "EC_01").select(
        F.concat(F.col("id"), F.lit(" ")).alias("id"),
        F.concat(F.lit(" "), "p_type", F.lit("\t")).alias("cat"),
        F.concat(F.lit(" "), "p_brand").alias("subcat"),
        F.concat(F.when(F.length("p_brand") == 7, "No").otherwise("Yes"), F.lit(NBSP)).alias("maintenance"),
    )


def bronze(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    builders = (crm_cust_info, crm_prd_info, crm_sales_details, erp_cust_az12, erp_loc_a101, erp_px_cat_g1v2)
    return {b.__name__: b(spark, sf_dir) for b in builders}


# The same extracts for DuckDB.
SQL = """
crm_sales_details AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS sls_ord_num,
         CAST(l_partkey AS VARCHAR) AS sls_prd_key,
         CASE WHEN l_orderkey % 109 = 0 THEN 'unknown'
              WHEN l_orderkey % 113 = 0 THEN CAST(o_custkey AS VARCHAR) || '.0'
              ELSE CAST(o_custkey AS VARCHAR) END AS sls_cust_id,
         CASE WHEN l_orderkey % 101 = 0 THEN '0' WHEN l_orderkey % 103 = 0 THEN '2013'
              WHEN l_orderkey % 107 = 0 THEN '20130230'
              ELSE ' ' || strftime(o_orderdate, '%Y%m%d') END AS sls_order_dt,
         strftime(l_shipdate, '%Y%m%d') AS sls_ship_dt,
         strftime(CAST(o_orderdate AS DATE) + 12, '%Y%m%d') AS sls_due_dt,
         CASE WHEN l_orderkey % 131 = 0 THEN '15' WHEN l_orderkey % 11 = 0 THEN '' WHEN l_orderkey % 13 = 0 THEN '999999'
              ELSE CAST(qty * price AS VARCHAR) END AS sls_sales,
         CASE WHEN l_orderkey % 131 = 0 THEN '1.5' WHEN l_orderkey % 127 = 0 THEN '0' ELSE CAST(qty AS VARCHAR) END AS sls_quantity,
         CASE WHEN l_orderkey % 131 = 0 THEN '10' WHEN l_orderkey % 17 = 0 THEN CAST(-price AS VARCHAR) WHEN l_orderkey % 19 = 0 THEN ''
              ELSE CAST(price AS VARCHAR) END AS sls_price
  FROM (SELECT *, CAST(l_quantity AS BIGINT) AS qty,
               CAST(round(l_extendedprice) AS BIGINT) // CAST(l_quantity AS BIGINT) AS price
        FROM lineitem) LEFT JOIN orders ON l_orderkey = o_orderkey
),
customer_copies AS (
  SELECT *, 0 AS copy FROM customer
  UNION ALL SELECT *, 1 FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT *, 2 FROM customer WHERE c_custkey % 31 = 0
),
crm_cust_info AS (
  SELECT CASE WHEN copy = 2 THEN '  ' ELSE ' ' || CAST(c_custkey AS VARCHAR) END AS cst_id,
         'AW' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cst_key,
         chr(9) || CASE WHEN copy = 1 THEN 'Old' ELSE 'New' END || chr(160) AS cst_firstname,
         '  ' || c_name || ' ' AS cst_lastname,
         CASE c_custkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN ' s' WHEN 2 THEN 'S ' ELSE '' END AS cst_marital_status,
         CASE c_custkey % 4 WHEN 0 THEN 'm' WHEN 1 THEN ' F ' WHEN 2 THEN 'X' ELSE '' END AS cst_gndr,
         CASE WHEN copy = 1 AND c_custkey % 29 = 0 THEN 'someday' WHEN copy = 1 THEN '2020-01-31'
              ELSE '2025-10-06' END AS cst_create_date
  FROM customer_copies
),
part_versions AS (
  SELECT *, 0 AS copy FROM part
  UNION ALL SELECT *, 1 FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT *, 2 FROM part WHERE p_partkey % 37 = 0
),
crm_prd_info AS (
  SELECT CAST(p_partkey * 3 + copy AS VARCHAR) AS prd_id,
         upper(p_type[1:2]) || '-' || lpad(replace(p_brand, 'Brand#', ''), 2, '0') || '-'
           || CAST(p_partkey AS VARCHAR) AS prd_key,
         ' ' || p_name || CASE WHEN copy > 0 THEN ' (v' || CAST(copy AS VARCHAR) ELSE '' END
           || chr(160) AS prd_nm,
         CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 23 = 0 THEN '12.75'
              ELSE CAST(p_size * 25 AS VARCHAR) END AS prd_cost,
         CASE p_partkey % 5 WHEN 0 THEN 'R ' WHEN 1 THEN 'm' WHEN 2 THEN 'S' WHEN 3 THEN ' t ' ELSE '' END AS prd_line,
         CASE copy WHEN 0 THEN '2013-07-01' WHEN 1 THEN '2011-07-01' ELSE '' END AS prd_start_dt,
         CASE WHEN copy = 1 THEN '2007-12-28' ELSE '' END AS prd_end_dt
  FROM part_versions
),
erp_cust_az12 AS (
  SELECT CASE WHEN c_custkey % 2 = 0 THEN 'NAS' ELSE '' END || 'AW'
           || lpad(CAST(c_custkey AS VARCHAR), 10, '0') || ' ' AS cid,
         CASE WHEN c_custkey % 47 = 0 THEN '2999-01-01' WHEN c_custkey % 59 = 0 THEN 'soon'
              WHEN c_custkey % 61 = 0 THEN '2002-03-04'
              ELSE CAST(DATE '1940-01-01' + CAST((c_custkey * 37) % 25000 AS INTEGER) AS VARCHAR) END AS bdate,
         CASE c_custkey % 5 WHEN 0 THEN 'F' WHEN 1 THEN 'FEMALE' WHEN 2 THEN 'm ' WHEN 3 THEN 'male' ELSE '' END AS gen
  FROM customer
),
erp_loc_a101 AS (
  SELECT 'AW-' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cid,
         CASE c_custkey % 9 WHEN 0 THEN 'DE' WHEN 1 THEN 'US ' WHEN 2 THEN 'USA' WHEN 3 THEN 'us'
              WHEN 4 THEN '' WHEN 5 THEN chr(160) ELSE ' ' || n_name || ' ' END AS cntry
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
),
erp_px_cat_g1v2 AS (
  SELECT DISTINCT upper(p_type[1:2]) || '_' || lpad(replace(p_brand, 'Brand#', ''), 2, '0') || ' ' AS id,
         ' ' || p_type || chr(9) AS cat, ' ' || p_brand AS subcat,
         CASE WHEN length(p_brand) = 7 THEN 'No' ELSE 'Yes' END || chr(160) AS maintenance
  FROM part
  WHERE NOT (upper(p_type[1:2]) = 'EC' AND p_brand = 'Brand#1')
)"""
