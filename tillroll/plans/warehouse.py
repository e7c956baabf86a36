"""Raw extracts to the star schema."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F, types as T

from tillroll.operators import gold, quality, silver
from tillroll.session import keep_methods_compiled
from tillroll.sources import extracts, publication, sinks


def build_silver(bronze: dict[str, DataFrame], as_of: dt.date | None = None) -> dict[str, DataFrame]:
    """All six cleaned extracts."""
    keep_methods_compiled(bronze["crm_sales_details"].sparkSession)
    return {
        "crm_cust_info": silver.clean_crm_cust_info(bronze["crm_cust_info"]),
        "crm_prd_info": silver.clean_crm_prd_info(bronze["crm_prd_info"]),
        "crm_sales_details": silver.clean_crm_sales_details(bronze["crm_sales_details"]),
        "erp_cust_az12": silver.clean_erp_cust_az12(bronze["erp_cust_az12"], as_of),
        "erp_loc_a101": silver.clean_erp_loc_a101(bronze["erp_loc_a101"]),
        "erp_px_cat": silver.clean_erp_px_cat(bronze["erp_px_cat_g1v2"]),
    }


def build_gold(cleaned: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The three star tables. The fact looks up keys alone, not the dimensions' other sources."""
    return {
        "dim_customers": gold.build_dim_customers(cleaned),
        "dim_products": gold.build_dim_products(cleaned),
        "fact_sales": gold.build_fact_sales(cleaned, gold.product_keys(cleaned), gold.customer_keys(cleaned)),
    }


def build_warehouse(bronze: dict[str, DataFrame], as_of: dt.date | None = None) -> dict[str, DataFrame]:
    """Raw extracts straight to the star tables."""
    return build_gold(build_silver(bronze, as_of))


def write_warehouse(
    bronze: dict[str, DataFrame], out: str, as_of: dt.date | None = None, inputs: Iterable[str] = (),
    by_year: bool = False,
) -> dict[str, DataFrame]:
    """Build and store the star tables, and return the stored ones.

    The dimensions are stored first and the fact looks its keys up in the stored rows, so
    they are cleaned once and a lost executor cannot change a key between the two. A key that a
    dimension holds twice would double sales and is refused. ``by_year`` stores the fact in a
    folder per order year, sorted by date, so that a slice of dates reads only its own files.
    """
    cleaned = build_silver(bronze, as_of)
    spark = cleaned["crm_sales_details"].sparkSession
    paths = sinks.save_tables({
        "dim_customers": gold.build_dim_customers(cleaned),
        "dim_products": gold.build_dim_products(cleaned),
    }, out, inputs=inputs)
    customers = extracts.load_customers(spark, paths["dim_customers"])
    products = extracts.load_products(spark, paths["dim_products"])
    for dimension, key in ((customers, "customer_id"), (products, "product_number")):
        twice = quality.duplicate_keys(dimension, key).first()
        if twice:
            raise ValueError(f"{key} {twice[key]} occurs {twice['copies']} times")
    fact = gold.build_fact_sales(cleaned, products, customers)
    if by_year:
        path = sinks.save_tables(
            {"fact_sales": fact.withColumn("order_year", F.year("order_date"))}, out, inputs=inputs,
            partition_by={"fact_sales": ["order_year"]}, sort_by={"fact_sales": ["order_date"]})["fact_sales"]
        stored = spark.read.schema(T.StructType([*fact.schema, T.StructField("order_year", T.IntegerType())])).parquet(path)
    else:
        stored = extracts.load_fact(spark, sinks.save_tables({"fact_sales": fact}, out, inputs=inputs)["fact_sales"])
    return {"dim_customers": customers, "dim_products": products, "fact_sales": stored}


def publish_warehouse(
    bronze: dict[str, DataFrame], out: str, as_of: dt.date | None = None, inputs: Iterable[str] = (),
) -> int:
    """Build the star tables beside those published in ``out`` before, check them and switch; the version.

    The fact lies in a folder per order year, each dealt out and sorted by date and order number, so
    that neither a hot day nor lines without a date make one task's file. A dimension without rows, a key
    without its NOT NULL, or a fact whose lines all miss a dimension is not published. Read the
    tables with `publication.current` and what the writes saw with `publication.measured`.
    """
    cleaned = build_silver(bronze, as_of)
    build = publication.Build(cleaned["crm_sales_details"].sparkSession, out, inputs)
    customers = build.write("dim_customers", gold.build_dim_customers(cleaned))
    products = build.write("dim_products", gold.build_dim_products(cleaned), sums=["cost"])
    for dimension, key in ((customers, "customer_id"), (products, "product_number")):
        twice = quality.duplicate_keys(dimension, key).first()
        if twice:
            raise ValueError(f"{key} {twice[key]} occurs {twice['copies']} times")
    fact = gold.build_fact_sales(cleaned, products, customers).withColumn("order_year", F.year("order_date"))
    build.write("fact_sales", fact, sums=["sales_amount", "quantity"], partition_by=["order_year"],
                cluster_by=["order_date", "order_number"])
    return build.publish(_finding)


def _finding(seen: dict[str, publication.Measures]) -> str | None:
    """What speaks against a build, if anything."""
    fact = seen["fact_sales"]
    for name, key in (("dim_customers", "customer_key"), ("dim_products", "product_key")):
        if seen[name].nulls[key]:
            return f"{name} has rows without {key}"
        if fact.rows and fact.nulls[key] == fact.rows:
            return f"no sales line knows its {key}"
    return None
