"""Bronze to Silver: typed, trimmed and repaired extracts.

Every transform but the customer de-duplication is row-wise, so it also runs on a stream.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.functions.dates import as_of_date, parse_compact_date, parse_iso_date
from tillroll.functions.numbers import parse_number, strict_integer, whole
from tillroll.functions.text import UNKNOWN, decode_code, is_blank, lookup, strip

# Source codes and their labels.
MARITAL_LABELS = {"M": "Married", "S": "Single"}
GENDER_LABELS = {"M": "Male", "F": "Female"}
PRODUCT_LINE_LABELS = {"M": "Mountain", "R": "Road", "S": "Other Sales", "T": "Touring"}
COUNTRY_LABELS = {"DE": "Germany", "US": "United States", "USA": "United States"}
GENDER_WORDS = {"F": "Female", "FEMALE": "Female", "M": "Male", "MALE": "Male"}
KEY_PREFIX = "NAS"


# --- CRM customers -------------------------------------------------------------------------

def keep_identified(bronze: DataFrame) -> DataFrame:
    """Drop rows with a blank customer id; any other id must be a whole number."""
    return bronze.where(~is_blank(F.col("cst_id"))).withColumn(
        "cst_id", strict_integer(F.col("cst_id"), "cst_id"))


def trim_names(bronze: DataFrame) -> DataFrame:
    return bronze.withColumns({c: strip(F.col(c)) for c in ("cst_firstname", "cst_lastname")})


def marital_label(c: Column) -> Column:
    return decode_code(c, MARITAL_LABELS)


def gender_label(c: Column) -> Column:
    return decode_code(c, GENDER_LABELS)


def latest_per(rows: DataFrame, key: str, date: str, *tie_break: Column) -> DataFrame:
    """One row per key: the latest date, where an unknown date beats any known one.

    A maximum over whole rows rather than a ranked window: each task first reduces its
    share of a key to one row, so a key with a third of all rows costs one row per task.
    """
    rest = [c for c in rows.columns if c != key]
    winner = F.max(F.struct(
        F.col(date).isNull().alias("_undated"),
        F.col(date).alias("_date"),
        *[c.alias(f"_tie{i}") for i, c in enumerate(tie_break)],
        F.struct(*rest).alias("_row"),
    ))
    best = rows.groupBy(key).agg(winner.alias("_best"))
    return best.select(
        *[F.col(c) if c == key else F.col("_best._row")[c].alias(c) for c in rows.columns])


def latest_customers(typed: DataFrame) -> DataFrame:
    return latest_per(typed, "cst_id", "cst_create_date")


def clean_crm_cust_info(bronze: DataFrame) -> DataFrame:
    typed = trim_names(keep_identified(bronze)).withColumns({
        "cst_marital_status": marital_label(F.col("cst_marital_status")),
        "cst_gndr": gender_label(F.col("cst_gndr")),
        "cst_create_date": parse_iso_date(F.col("cst_create_date")),
    })
    return latest_customers(typed)


# --- CRM products --------------------------------------------------------------------------

def category_id(product_code: Column) -> Column:
    """Characters 1 to 5 of the composite code, dashes as underscores."""
    return F.translate(F.substring(product_code, 1, 5), "-", "_")


def product_number(product_code: Column) -> Column:
    """The composite code from character 7 on."""
    return F.substr(product_code, F.lit(7))


def whole_cost(c: Column) -> Column:
    """Cost text to bigint, unknown as 0, any fraction cut off."""
    return F.coalesce(parse_number(c), F.lit(0.0)).cast("bigint")


def product_line_label(c: Column) -> Column:
    return decode_code(c, PRODUCT_LINE_LABELS)


def clean_crm_prd_info(bronze: DataFrame) -> DataFrame:
    return bronze.select(
        "prd_id",
        product_number(F.col("prd_key")).alias("prd_key"),
        strip(F.col("prd_nm")).alias("prd_nm"),
        whole_cost(F.col("prd_cost")).alias("prd_cost"),
        product_line_label(F.col("prd_line")).alias("prd_line"),
        parse_iso_date(F.col("prd_start_dt")).alias("prd_start_dt"),
        parse_iso_date(F.col("prd_end_dt")).alias("prd_end_dt"),
        category_id(F.col("prd_key")).alias("cat_id"),
    )


# --- CRM sales -----------------------------------------------------------------------------

def repaired_sales(sales: Column, quantity: Column, price: Column, strict_null: bool = True) -> Column:
    """Sales amount, recomputed as quantity × |price| unless positive and equal to it.

    A missing price or quantity counts as unequal, so the amount becomes NULL with it.
    ``strict_null=False`` keeps the stated amount in that case.
    """
    expected = quantity * F.abs(price)
    agrees = sales.eqNullSafe(expected)
    if not strict_null:
        agrees = agrees | expected.isNull()
    return F.when(sales.isNull() | (sales <= 0) | ~agrees, expected).otherwise(sales)


def repaired_price(price: Column, sales: Column, quantity: Column) -> Column:
    """Unit price, rebuilt from repaired sales when missing or not positive."""
    rebuilt = sales / F.nullif(quantity, F.lit(0.0))
    return F.bround(F.when(price.isNull() | (price <= 0), rebuilt).otherwise(price))


def clean_crm_sales_details(bronze: DataFrame, strict_null: bool = True) -> DataFrame:
    """Dates and amounts typed and repaired; quantity is never repaired.

    A fractional quantity counts in full towards amount and price and is stored rounded, half to
    even, as the price is. Only a fractional amount fails the job.
    """
    typed = bronze.withColumns({
        **{c: parse_compact_date(F.col(c)) for c in ("sls_order_dt", "sls_ship_dt", "sls_due_dt")},
        **{c: parse_number(F.col(c)) for c in ("sls_sales", "sls_quantity", "sls_price")},
    })
    quantity, price = F.col("sls_quantity"), F.col("sls_price")
    with_sales = typed.withColumn(
        "sls_sales", repaired_sales(F.col("sls_sales"), quantity, price, strict_null))
    with_price = with_sales.withColumn(
        "sls_price", repaired_price(price, F.col("sls_sales"), quantity))
    return with_price.withColumns({
        "sls_sales": whole(F.col("sls_sales"), "sls_sales"),
        "sls_quantity": F.bround(quantity).cast("bigint"),
        "sls_price": F.col("sls_price").cast("bigint"),
    })


# --- ERP extracts --------------------------------------------------------------------------

def unprefixed_key(c: Column) -> Column:
    """Customer key without its source prefix; the prefix goes first, padding after."""
    return strip(F.regexp_replace(c, f"^{KEY_PREFIX}", ""))


def past_date(d: Column, as_of: dt.date | Column | None = None) -> Column:
    """The date, NULL when it lies after the reporting day."""
    return F.when(d <= as_of_date(as_of), d)


def gender_word_label(c: Column) -> Column:
    return decode_code(c, GENDER_WORDS)


def clean_erp_cust_az12(bronze: DataFrame, as_of: dt.date | Column | None = None) -> DataFrame:
    return bronze.withColumns({
        "cid": unprefixed_key(F.col("cid")),
        "bdate": past_date(parse_iso_date(F.col("bdate")), as_of),
        "gen": gender_word_label(F.col("gen")),
    })


def undashed_key(c: Column) -> Column:
    return strip(F.translate(c, "-", ""))


def country_label(c: Column) -> Column:
    """Known codes decoded as written, blanks unknown, other names as they are."""
    name = strip(c)
    return F.coalesce(lookup(name, {**COUNTRY_LABELS, "": UNKNOWN}), name, F.lit(UNKNOWN))


def clean_erp_loc_a101(bronze: DataFrame) -> DataFrame:
    return bronze.withColumns({
        "cid": undashed_key(F.col("cid")),
        "cntry": country_label(F.col("cntry")),
    })


def clean_erp_px_cat(bronze: DataFrame) -> DataFrame:
    return bronze.select(*[strip(F.col(c)).alias(c) for c in bronze.columns])
