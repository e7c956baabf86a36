"""Optional check against files of a known warehouse; set the variables to run it.

``GOLDEN_PRODUCTS_RAW`` and ``GOLDEN_CATEGORIES_RAW`` are raw extracts, ``GOLDEN_PRODUCTS`` the
product dimension they lead to, and ``GOLDEN_PRODUCT_REPORT`` a product report as of January
2025.
"""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tillroll.functions.dates import months_crossed
from tillroll.functions.numbers import int_divide
from tillroll.operators import gold, labels, silver
from tillroll.sources import extracts


def golden(variable):
    path = os.environ.get(variable)
    if not path:
        pytest.skip(f"{variable} not set")
    return path


def test_product_dimension(spark):
    raw = extracts.read_bronze(spark, "crm_prd_info", golden("GOLDEN_PRODUCTS_RAW"))
    categories = extracts.read_bronze(spark, "erp_px_cat_g1v2", golden("GOLDEN_CATEGORIES_RAW"))
    known = extracts.load_products(spark, golden("GOLDEN_PRODUCTS"), "csv").drop("product_key")
    built = gold.build_dim_products({
        "crm_prd_info": silver.clean_crm_prd_info(raw), "erp_px_cat": silver.clean_erp_px_cat(categories)})
    built = built.drop("product_key")
    assert known.count() == built.count() == 295
    assert built.exceptAll(known).count() == 0 and known.exceptAll(built).count() == 0


def test_product_report(spark):
    known = extracts.load_report_products(spark, golden("GOLDEN_PRODUCT_REPORT"), "csv")
    c = F.col
    off = known.where(
        (labels.product_segment(c("total_sales")) != c("product_segment"))
        | (int_divide(c("total_sales"), c("total_orders")) != c("avg_order_revenue"))
        | (F.when(c("lifespan") == 0, c("total_sales")).otherwise(int_divide(c("total_sales"), c("lifespan")))
           != c("avg_monthly_revenue"))
        | (months_crossed(c("last_sale_date"), F.lit(dt.date(2025, 1, 15))) != c("recency_in_months")))
    assert known.count() == 130 and off.count() == 0
