"""Silver to Gold: the customer and product dimensions and the sales fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.functions.numbers import lookup_integer, strict_integer
from tillroll.functions.text import UNKNOWN
from tillroll.operators.keys import dense_keys
from tillroll.operators.silver import latest_per


def preferred_gender(crm: Column, erp: Column) -> Column:
    """The CRM label unless unknown, then the ERP label, then unknown."""
    return F.when(crm != UNKNOWN, crm).otherwise(F.coalesce(erp, F.lit(UNKNOWN)))


def unique_rows(rows: DataFrame, key: str, what: str) -> DataFrame:
    """The rows with a known key; a key that occurs twice fails the job, as it would double what joins it.

    The proof counts rows by key on the key column alone, in a subquery; the rows themselves are
    neither grouped nor sorted for it.
    """
    known = rows.where(F.col(key).isNotNull())
    twice = known.groupBy(key).agg(F.count("*").alias("_copies")).where("_copies > 1").select(
        F.col(key).cast("string").alias("_twice")).limit(1).scalar()
    failure = F.raise_error(F.concat(F.lit(f"{what} holds a key twice: "), twice))
    return known.where(F.when(twice.isNull(), F.lit(True)).otherwise(failure.cast("boolean")))


def join_customer_sources(silver: dict[str, DataFrame]) -> DataFrame:
    """CRM customers with their ERP birthdate and gender and their country."""
    crm = silver["crm_cust_info"]
    erp = unique_rows(silver["erp_cust_az12"], "cid", "erp_cust_az12").select(
        F.col("cid").alias("_erp_key"), "bdate", "gen")
    place = unique_rows(silver["erp_loc_a101"], "cid", "erp_loc_a101").select(
        F.col("cid").alias("_place_key"), "cntry")
    joined = crm.join(erp, crm.cst_key == F.col("_erp_key"), "left").join(
        place, crm.cst_key == F.col("_place_key"), "left")
    return joined.select(
        F.col("cst_id").alias("customer_id"),
        F.col("cst_key").alias("customer_number"),
        F.col("cst_firstname").alias("first_name"),
        F.col("cst_lastname").alias("last_name"),
        F.coalesce("cntry", F.lit(UNKNOWN)).alias("country"),
        F.col("cst_marital_status").alias("marital_status"),
        preferred_gender(F.col("cst_gndr"), F.col("gen")).alias("gender"),
        F.col("bdate").alias("birthdate"),
        F.col("cst_create_date").alias("create_date"),
    )


def customer_keys(silver: dict[str, DataFrame]) -> DataFrame:
    """(customer_key, customer_id), numbered by id from one narrow column; all that a fact looks up."""
    return dense_keys(silver["crm_cust_info"].select(F.col("cst_id").alias("customer_id")),
                      "customer_id", "customer_key")


def build_dim_customers(silver: dict[str, DataFrame]) -> DataFrame:
    """Customers numbered by id. Ids are numbered before the sources are joined."""
    sources = join_customer_sources(silver)
    return customer_keys(silver).join(sources, "customer_id").select("customer_key", *sources.columns)


def current_products(silver: dict[str, DataFrame]) -> DataFrame:
    """The latest version of each product number."""
    versions = silver["crm_prd_info"].withColumn("prd_id", strict_integer(F.col("prd_id"), "prd_id"))
    return latest_per(versions, "prd_key", "prd_start_dt", F.col("prd_id"))


def product_keys(silver: dict[str, DataFrame]) -> DataFrame:
    """(product_key, product_id, product_number) of current products, by id, and by number where two share one."""
    return dense_keys(
        current_products(silver).select(F.col("prd_id").alias("product_id"), F.col("prd_key").alias("product_number")),
        "product_id", "product_key", "product_number")


def build_dim_products(silver: dict[str, DataFrame]) -> DataFrame:
    """Current products with their category, numbered by `product_keys`."""
    current = current_products(silver)
    lookup = unique_rows(silver["erp_px_cat"], "id", "erp_px_cat_g1v2")
    enriched = current.join(lookup, current.cat_id == lookup.id, "left").select(
        F.col("prd_id").alias("product_id"),
        F.col("prd_key").alias("product_number"),
        F.col("prd_nm").alias("product_name"),
        F.col("cat_id").alias("category_id"),
        F.col("cat").alias("category"),
        F.col("subcat").alias("subcategory"),
        "maintenance",
        F.col("prd_cost").alias("cost"),
        F.col("prd_line").alias("product_line"),
        F.col("prd_start_dt").alias("start_date"),
    )
    return product_keys(silver).join(enriched, ["product_id", "product_number"]).select("product_key", *enriched.columns)


def build_fact_sales(
    silver: dict[str, DataFrame], dim_products: DataFrame, dim_customers: DataFrame
) -> DataFrame:
    """Sales lines with surrogate keys; a line that finds no dimension row keeps NULL.

    Of the dimensions only ids and keys are needed, so `product_keys` and `customer_keys` do as well.

    Both lookups shuffle line and dimension directly into the join, the shape in which
    adaptive execution splits a hot (or NULL) key over many tasks.
    """
    lines = silver["crm_sales_details"].withColumn(
        "_customer_id", lookup_integer(F.col("sls_cust_id"), "sls_cust_id"))
    products = dim_products.select("product_key", F.col("product_number").alias("_product_number"))
    customers = dim_customers.select("customer_key", F.col("customer_id").alias("_known_id"))
    return (
        lines.join(products, lines.sls_prd_key == F.col("_product_number"), "left")
        .join(customers, F.col("_customer_id") == F.col("_known_id"), "left")
        .select(
            F.col("sls_ord_num").alias("order_number"),
            "product_key",
            "customer_key",
            F.col("sls_order_dt").alias("order_date"),
            F.col("sls_ship_dt").alias("shipping_date"),
            F.col("sls_due_dt").alias("due_date"),
            F.col("sls_sales").alias("sales_amount"),
            F.col("sls_quantity").alias("quantity"),
            F.col("sls_price").alias("price"),
        )
    )
