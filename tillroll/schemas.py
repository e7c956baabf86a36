"""Declared schemas of every stored table; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)


def _schema(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


def _text(*columns: str) -> StructType:
    return _schema(**{c: StringType() for c in columns})


BRONZE = {
    "crm_cust_info": _text(
        "cst_id", "cst_key", "cst_firstname", "cst_lastname",
        "cst_marital_status", "cst_gndr", "cst_create_date"),
    "crm_prd_info": _text(
        "prd_id", "prd_key", "prd_nm", "prd_cost", "prd_line", "prd_start_dt", "prd_end_dt"),
    "crm_sales_details": _text(
        "sls_ord_num", "sls_prd_key", "sls_cust_id", "sls_order_dt", "sls_ship_dt", "sls_due_dt",
        "sls_sales", "sls_quantity", "sls_price"),
    "erp_cust_az12": _text("cid", "bdate", "gen"),
    "erp_loc_a101": _text("cid", "cntry"),
    "erp_px_cat_g1v2": _text("id", "cat", "subcat", "maintenance"),
}

FACT_SALES = _schema(
    order_number=StringType(), product_key=LongType(), customer_key=LongType(),
    order_date=DateType(), shipping_date=DateType(), due_date=DateType(),
    sales_amount=LongType(), quantity=LongType(), price=LongType())

DIM_CUSTOMERS = _schema(
    customer_key=LongType(), customer_id=LongType(), customer_number=StringType(),
    first_name=StringType(), last_name=StringType(), country=StringType(),
    marital_status=StringType(), gender=StringType(), birthdate=DateType(), create_date=DateType())

DIM_PRODUCTS = _schema(
    product_key=LongType(), product_id=LongType(), product_number=StringType(),
    product_name=StringType(), category_id=StringType(), category=StringType(),
    subcategory=StringType(), maintenance=StringType(), cost=LongType(),
    product_line=StringType(), start_date=DateType())

REPORT_CUSTOMERS = _schema(
    customer_key=LongType(), customer_number=StringType(), customer_name=StringType(),
    age=IntegerType(), age_group=StringType(), customer_segment=StringType(),
    last_order_date=DateType(), recency=IntegerType(), total_orders=LongType(),
    total_sales=LongType(), total_quantity=LongType(), total_products=LongType(),
    lifespan=IntegerType(), avg_order_value=LongType(), avg_monthly_spend=LongType())

REPORT_PRODUCTS = _schema(
    product_key=LongType(), product_name=StringType(), category=StringType(),
    subcategory=StringType(), cost=LongType(), last_sale_date=DateType(),
    recency_in_months=IntegerType(), product_segment=StringType(), lifespan=IntegerType(),
    total_orders=LongType(), total_sales=LongType(), total_quantity=LongType(),
    total_customers=LongType(), avg_selling_price=DoubleType(), avg_order_revenue=LongType(),
    avg_monthly_revenue=LongType())

SALES = StructType(FACT_SALES.fields + _schema(
    product_name=StringType(), category=StringType(), subcategory=StringType(), cost=LongType(),
    country=StringType(), gender=StringType(), marital_status=StringType(),
    customer_segment=StringType(), age_group=StringType(), order_month=DateType(),
    order_year=IntegerType(), profit=LongType(), is_returning=BooleanType()).fields)
