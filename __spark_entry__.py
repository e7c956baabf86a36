"""

generated test data, seen as a star schema (``fixtures/star.py``) or as raw, dirty extracts
(``fixtures/bronze.py``).
"""

from __future__ import annotations

import datetime as dt
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fixtures import bronze as raw
from fixtures import oracle
from fixtures.star import AS_OF, HIGH_SPEND, dim_customers, dim_products, dirty_fact_sales, fact_sales
from tillroll.functions import dates, numbers
from tillroll.operators import (
    explore, frames, gold, insights, keys, quality, ranking, reports, segments, silver, snapshot, trend,
)
from tillroll.plans import co_located, sales_model, star_parts, warehouse
from tillroll.sources import extracts, publication, sinks, views

try:
    from tillroll.llm import queries as llm
except ModuleNotFoundError as missing:
    # the operators for training text may be absent as a whole, but not in part
    if missing.name not in ("tillroll.llm", "corpus_pipeline"):
        raise
    llm = None

Query = Callable[[SparkSession, str], DataFrame]

# The slice the dashboard-style operators run on besides the whole frame.
SLICE = {
    "date_range": (dt.date(1996, 1, 1), dt.date(1999, 12, 31)),
    "categories": ["ECONOMY", "LARGE", "PROMO"],
    "countries": ["NATION_1", "NATION_2", "NATION_3", "NATION_5", "NATION_8"],
    "segments": ["VIP", "Regular"],
}
STORED_SLICE = (dt.date(1996, 3, 10), dt.date(1996, 9, 20))
NO_DATES = (dt.date(1900, 1, 1), dt.date(1900, 12, 31))


# --- tables --------------------------------------------------------------------------------

def sales_frame(spark: SparkSession, sf_dir: str, *columns: str, dirty: bool = False) -> DataFrame:
    """The sales frame with the columns a query needs."""
    fact = (dirty_fact_sales if dirty else fact_sales)(spark, sf_dir)
    return sales_model.build_sales(
        fact, dim_products(spark, sf_dir), dim_customers(spark, sf_dir), as_of=AS_OF,
        columns=columns or None, segment_spend=HIGH_SPEND)


def sales_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_model.apply_filters(sales_frame(spark, sf_dir), **SLICE)


def no_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_model.apply_filters(sales_frame(spark, sf_dir), NO_DATES)


def saved(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows as a stored table, for a report that reads them several times."""
    path = sinks.save_tables({"rows": rows}, shared_folder(spark))["rows"]
    return spark.read.schema(rows.schema).parquet(path)


def cleaned(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return warehouse.build_silver(raw.bronze(spark, sf_dir), AS_OF)


# --- query builders ------------------------------------------------------------------------

def on_fact(op: Callable, *columns: str, **options) -> Query:
    return lambda spark, d: op(fact_sales(spark, d, *columns), **options)


def on_customers(op: Callable, **options) -> Query:
    return lambda spark, d: op(dim_customers(spark, d), **options)


def on_products(op: Callable, **options) -> Query:
    return lambda spark, d: op(dim_products(spark, d), **options)


def fact_by_product(op: Callable, *columns: str, fact: Callable = fact_sales, **options) -> Query:
    return lambda spark, d: op(fact(spark, d, *columns), dim_products(spark, d), **options)


def fact_by_customer(op: Callable, *columns: str, fact: Callable = fact_sales, **options) -> Query:
    return lambda spark, d: op(fact(spark, d, *columns), dim_customers(spark, d), **options)


def on_sales(op: Callable, *columns: str, dirty: bool = False, **options) -> Query:
    return lambda spark, d: op(sales_frame(spark, d, *columns, dirty=dirty), **options)


def star_slice(spark: SparkSession, sf_dir: str, **filters) -> tuple[DataFrame, DataFrame | None]:
    """The narrow lines of a filter, and the customers' profile where the whole history decides it.

    Filtered lines are stored, for three parts read them.
    """
    fact, products = fact_sales(spark, sf_dir, *star_parts.LINE_COLUMNS), dim_products(spark, sf_dir)
    if not filters:
        return star_parts.star_lines(fact, products, None), None
    dated = fact.where(F.col("order_date").isNotNull())
    profile = saved(spark, star_parts.profile_of(dated, dim_customers(spark, sf_dir), AS_OF, segment_spend=HIGH_SPEND))
    return saved(spark, star_parts.star_lines(fact, products, profile, **filters)), profile


def on_star_parts(op: Callable, **filters) -> Query:
    """For the reports of many parts: reduce the lines to the tables they read again, and store those."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines, profile = star_slice(spark, sf_dir, **filters)
        months = saved(spark, star_parts.customer_months(lines))
        if profile is None:  # all lines are there, so their sums by month tell first year and segment
            profile = star_parts.profile_of(months, dim_customers(spark, sf_dir), AS_OF, segment_spend=HIGH_SPEND)
        return op({
            "products": saved(spark, star_parts.product_part(lines, dim_products(spark, sf_dir))),
            "customers": saved(spark, star_parts.customer_part(months, profile)),
            "orders": star_parts.order_part(lines),
        })

    return run


def on_headline(op: Callable, **filters) -> Query:
    """For the headline figures alone, nothing is stored and no customer is looked up for them."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines, _ = star_slice(spark, sf_dir, **filters)
        return op(star_parts.headline_parts(lines, dim_products(spark, sf_dir)))

    return run


def headline(parts: dict[str, DataFrame]) -> DataFrame:
    return insights.kpis_of(parts).drop("lines")


def on_raw(extract: Callable, op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: op(extract(spark, d))


def raw_columns(extract: Callable, *kept: str, **computed: tuple[Callable, str]) -> Query:
    """Some raw columns next to cleaned ones, given as name=(cleaning, raw column)."""
    return on_raw(extract, lambda rows: rows.select(
        *kept, *[clean(F.col(c)).alias(name) for name, (clean, c) in computed.items()]))


def sales_amounts(op: Callable[..., Column], name: str) -> Query:
    """A repaired amount of the raw sales lines, from the parsed amounts."""
    def run(rows: DataFrame) -> DataFrame:
        parsed = [numbers.parse_number(F.col(c)) for c in ("sls_sales", "sls_quantity", "sls_price")]
        return rows.select("sls_ord_num", "sls_prd_key", op(*parsed).alias(name))

    return on_raw(raw.crm_sales_details, run)


def on_silver(op: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    return lambda spark, d: op(cleaned(spark, d))


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one; a local session without one is given its own."""
    context = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()) \
            and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tillroll-"))
    return sinks.shared_folder(spark)


# --- sources and sinks ---------------------------------------------------------------------

def read_bronze_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw.crm_cust_info(spark, sf_dir)
    path = sinks.save_tables({"crm_cust_info": rows}, shared_folder(spark), "csv")["crm_cust_info"]
    return extracts.read_bronze(spark, "crm_cust_info", path)


def stored(load: Callable, build: Query, fmt: str = "parquet") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        paths = sinks.save_tables({"rows": build(spark, sf_dir)}, shared_folder(spark), fmt)
        return load(spark, paths["rows"], fmt)

    return run


def save_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {
        "dim_customers": dim_customers(spark, sf_dir),
        "dim_products": dim_products(spark, sf_dir),
        "fact_sales": fact_sales(spark, sf_dir),
    }
    paths = sinks.save_tables(tables, shared_folder(spark), inputs=[sf_dir])
    loaded = {
        "dim_customers": extracts.load_customers(spark, paths["dim_customers"]),
        "dim_products": extracts.load_products(spark, paths["dim_products"]),
        "fact_sales": extracts.load_fact(spark, paths["fact_sales"]),
    }
    return quality.row_count_match(loaded, tables)


def export_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sales_slice(spark, sf_dir).select("order_number", "order_date", "category", "country", "sales_amount")
    path = sinks.export_csv(rows, shared_folder(spark))
    return extracts.read_table(spark, rows.schema, path, "csv")


def publish_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.publish_view(REPORTS["products"](spark, sf_dir), "report_products")


def publish_report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.publish_table(REPORTS["customers"](spark, sf_dir), "tillroll_report_customers")


def published(name: str) -> Query:
    """Every row of a star table as published: built, checked, switched to and read back."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = shared_folder(spark)
        warehouse.publish_warehouse(raw.bronze(spark, sf_dir), out, AS_OF, inputs=[sf_dir])
        return publication.current(spark, out)[name].drop("order_year")

    return run


def published_star(spark: SparkSession, sf_dir: str, fact: Callable = fact_sales) -> str:
    """The fixture's star, published; the folder."""
    build = publication.Build(spark, shared_folder(spark), [sf_dir])
    build.write("dim_customers", dim_customers(spark, sf_dir))
    build.write("dim_products", dim_products(spark, sf_dir), sums=["cost"])
    build.write("fact_sales", fact(spark, sf_dir).withColumn("order_year", F.year("order_date")),
                sums=["sales_amount"], partition_by=["order_year"], cluster_by=["order_date", "order_number"])
    build.publish()
    return build.out


def observed_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publication.measured(spark, published_star(spark, sf_dir, dirty_fact_sales)).where(
        "table_name = 'fact_sales' AND coalesce(column_name, '') <> 'order_year'")


def stored_date_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = publication.current(spark, published_star(spark, sf_dir))["fact_sales"]
    return sales_model.date_slice(fact, *STORED_SLICE).drop("order_year")


def persistent_report(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = shared_folder(spark)
        paths = sinks.save_tables({
            "dim_customers": dim_customers(spark, sf_dir), "dim_products": dim_products(spark, sf_dir),
            "fact_sales": fact_sales(spark, sf_dir)}, folder, inputs=[sf_dir])
        shown = views.publish_report_views(
            spark, paths, "tillroll_view_customers", "tillroll_view_products", AS_OF, HIGH_SPEND)
        return shown[f"tillroll_view_{name}"]

    return run


def co_located_sales(*columns: str, fact: Callable = fact_sales) -> Query:
    """The sales frame from tables bucketed by customer; customers of over 100 lines count as hot here."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        name = f"tillroll_by_customer_{fact.__name__}"
        co_located.store_by_customer(
            fact(spark, sf_dir), dim_customers(spark, sf_dir), name, shared_folder(spark), buckets=8, hot_lines=100)
        return co_located.build_co_located(
            spark, name, dim_products(spark, sf_dir), AS_OF, columns=columns or None, segment_spend=HIGH_SPEND)

    return run


REPORTS: dict[str, Query] = {
    "customers": fact_by_customer(
        reports.report_customers, as_of=AS_OF, segment_spend=HIGH_SPEND, keys_verified=True),
    "products": fact_by_product(reports.report_products, as_of=AS_OF, keys_verified=True),
}


def key_summary(tables: dict[str, DataFrame]) -> DataFrame:
    key = {"dim_customers": "customer_key", "dim_products": "product_key", "fact_sales": "customer_key"}
    parts = [
        table.agg(F.count("*").alias("row_count"), F.sum(key[name]).alias("key_sum"))
        .select(F.lit(name).alias("table_name"), "row_count", "key_sum")
        for name, table in tables.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def gold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_summary(warehouse.build_gold(cleaned(spark, sf_dir)))


def written_warehouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_summary(warehouse.write_warehouse(
        raw.bronze(spark, sf_dir), shared_folder(spark), AS_OF, inputs=[sf_dir]))


def rebuilt_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = warehouse.build_warehouse(raw.bronze(spark, sf_dir), AS_OF)
    return explore.revenue_by_category(tables["fact_sales"], tables["dim_products"])


# --- contract ------------------------------------------------------------------------------

def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the product report over the smallest test data."""
    return REPORTS["products"](spark, "/root/testdata/sf0.001")


def _source_queries() -> dict[str, Query]:
    return {
        "a01_read_bronze_csv": read_bronze_csv,
        "a02_read_gold_csv": stored(extracts.load_customers, dim_customers, "csv"),
        "a03_load_fact": stored(extracts.load_fact, fact_sales),
        "a04_load_customers": stored(extracts.load_customers, dim_customers),
        "a05_load_products": stored(extracts.load_products, dim_products),
        "a06_load_report_customers": stored(extracts.load_report_customers, REPORTS["customers"]),
        "a07_load_report_products": stored(extracts.load_report_products, REPORTS["products"]),
        "a08_save_gold_tables": save_gold,
        "a08_write_warehouse": written_warehouse,
        "a08_published_customers": published("dim_customers"),
        "a08_published_products": published("dim_products"),
        "a08_published_fact": published("fact_sales"),
        "a09_export_slice_csv": export_slice,
        "a10_publish_report_view": publish_report,
        "a10_publish_report_table": publish_report_table,
        "a10_persistent_view_customers": persistent_report("customers"),
        "a10_persistent_view_products": persistent_report("products"),
    }


def _silver_queries() -> dict[str, Query]:
    def dated_customers(rows: DataFrame) -> DataFrame:
        return silver.keep_identified(rows).withColumn(
            "cst_create_date", dates.parse_iso_date(F.col("cst_create_date")))

    def lenient_sales(sales: Column, quantity: Column, price: Column) -> Column:
        return silver.repaired_sales(sales, quantity, price, strict_null=False)

    def price_of(sales: Column, quantity: Column, price: Column) -> Column:
        return silver.repaired_price(price, silver.repaired_sales(sales, quantity, price), quantity)

    def past_birthdate(c: Column) -> Column:
        return silver.past_date(dates.parse_iso_date(c), AS_OF)

    return {
        "b01_identified_customers": on_raw(
            raw.crm_cust_info, lambda r: silver.keep_identified(r).select("cst_id", "cst_key")),
        "b02_trimmed_names": on_raw(
            raw.crm_cust_info, lambda r: silver.trim_names(r).select("cst_key", "cst_firstname", "cst_lastname")),
        "b03_marital_labels": raw_columns(
            raw.crm_cust_info, "cst_key", marital_status=(silver.marital_label, "cst_marital_status")),
        "b04_gender_labels": raw_columns(
            raw.crm_cust_info, "cst_key", gender=(silver.gender_label, "cst_gndr")),
        "b05_create_dates": raw_columns(
            raw.crm_cust_info, "cst_key", create_date=(dates.parse_iso_date, "cst_create_date")),
        "b06_latest_customers": on_raw(
            raw.crm_cust_info, lambda r: silver.latest_customers(dated_customers(r))),
        "b07_clean_crm_cust_info": on_raw(raw.crm_cust_info, silver.clean_crm_cust_info),
        "b08_product_key_split": raw_columns(
            raw.crm_prd_info, "prd_id", cat_id=(silver.category_id, "prd_key"),
            product_number=(silver.product_number, "prd_key")),
        "b09_product_costs": raw_columns(raw.crm_prd_info, "prd_id", cost=(silver.whole_cost, "prd_cost")),
        "b10_product_lines": raw_columns(
            raw.crm_prd_info, "prd_id", product_line=(silver.product_line_label, "prd_line")),
        "b11_product_names_and_dates": on_raw(
            raw.crm_prd_info,
            lambda r: silver.clean_crm_prd_info(r).select("prd_id", "prd_nm", "prd_start_dt", "prd_end_dt")),
        "b12_clean_crm_prd_info": on_raw(raw.crm_prd_info, silver.clean_crm_prd_info),
        "b13_compact_dates": raw_columns(
            raw.crm_sales_details, "sls_ord_num", "sls_order_dt",
            order_date=(dates.parse_compact_date, "sls_order_dt")),
        "b14_repaired_sales": sales_amounts(silver.repaired_sales, "sales"),
        "b14_repaired_sales_lenient": sales_amounts(lenient_sales, "sales"),
        "b15_repaired_prices": sales_amounts(price_of, "price"),
        "b16_clean_crm_sales_details": on_raw(raw.crm_sales_details, silver.clean_crm_sales_details),
        "b17_erp_customer_keys": raw_columns(raw.erp_cust_az12, cid=(silver.unprefixed_key, "cid")),
        "b18_past_birthdates": raw_columns(raw.erp_cust_az12, "cid", birthdate=(past_birthdate, "bdate")),
        "b19_erp_gender_labels": raw_columns(
            raw.erp_cust_az12, "cid", gender=(silver.gender_word_label, "gen")),
        "b20_clean_erp_cust_az12": on_raw(raw.erp_cust_az12, lambda r: silver.clean_erp_cust_az12(r, AS_OF)),
        "b21_clean_erp_loc_a101": on_raw(raw.erp_loc_a101, silver.clean_erp_loc_a101),
        "b22_clean_erp_px_cat": on_raw(raw.erp_px_cat_g1v2, silver.clean_erp_px_cat),
    }


def _gold_queries() -> dict[str, Query]:
    def fact(s: dict[str, DataFrame]) -> DataFrame:
        return gold.build_fact_sales(s, gold.product_keys(s), gold.customer_keys(s))

    return {
        "c01_dim_customers": on_silver(gold.build_dim_customers),
        "c02_preferred_gender": on_silver(
            lambda s: gold.join_customer_sources(s).select("customer_id", "gender")),
        "c03_customer_country": on_silver(
            lambda s: gold.join_customer_sources(s).select("customer_id", "country")),
        "c04_dense_keys": lambda spark, d: keys.dense_keys(
            dim_customers(spark, d).select("customer_id"), "customer_id", "customer_key"),
        "c05_dim_products": on_silver(gold.build_dim_products),
        "c06_fact_sales": on_silver(fact),
        "c07_gold_tables": gold_summary,
        "c08_bronze_to_gold_revenue": rebuilt_revenue,
    }


def _model_queries() -> dict[str, Query]:
    def periods(sales: DataFrame) -> DataFrame:
        return sales.groupBy("order_month", "order_year").agg(F.count("*").alias("lines"))

    def profits(sales: DataFrame) -> DataFrame:
        return sales.groupBy("product_key").agg(
            F.sum("profit").alias("profit"), F.count("profit").alias("lines_with_profit"))

    def returning(sales: DataFrame) -> DataFrame:
        return sales.groupBy("order_year", "is_returning").agg(
            F.sum("sales_amount").alias("sales_amount"), F.count("*").alias("lines"))

    def half_open(spark: SparkSession, d: str) -> DataFrame:
        rows = sales_frame(spark, d, "order_date", "country", "sales_amount")
        return explore.total_sales(sales_model.apply_filters(
            rows, (dt.date(1996, 1, 1), None), countries=SLICE["countries"]))

    return {
        "m01_sales_frame": on_sales(lambda s: s),
        "m01_sales_frame_dirty_keys": on_sales(lambda s: s, dirty=True),
        "m01_sales_frame_saved_segments": lambda spark, d: sales_model.build_sales(
            fact_sales(spark, d), dim_products(spark, d), dim_customers(spark, d),
            stored(extracts.load_report_customers, REPORTS["customers"])(spark, d)),
        "m02_dated_lines": on_sales(lambda s: s.agg(F.count("*").alias("lines")), "order_date"),
        "m03_periods": on_sales(periods, "order_month", "order_year"),
        "m04_line_profit": on_sales(profits, "product_key", "profit"),
        "m05_returning_flag": on_sales(returning, "order_year", "is_returning", "sales_amount"),
        "m05_returning_flag_dirty_keys": on_sales(
            returning, "order_year", "is_returning", "sales_amount", dirty=True),
        "m01_sales_frame_co_located": co_located_sales(),
        "m05_returning_flag_co_located": lambda spark, d: returning(
            co_located_sales("order_year", "is_returning", "sales_amount")(spark, d)),
        "m05_returning_flag_co_located_dirty_keys": lambda spark, d: returning(
            co_located_sales("order_year", "is_returning", "sales_amount", fact=dirty_fact_sales)(spark, d)),
        "m06_filter_options": on_sales(
            sales_model.filter_options, "order_date", "category", "country", "customer_segment"),
        "m07_filters": sales_slice,
        "m07_filters_stored_date_slice": stored_date_slice,
        "m07_filters_half_open_range": half_open,
        "m07_filters_no_match": no_sales,
    }


def _script_queries() -> dict[str, Query]:
    order_lines = ("customer_key", "order_number")
    return {
        "e01_customer_countries": on_customers(explore.customer_countries),
        "e02_product_hierarchy": on_products(explore.product_hierarchy),
        "e03_order_date_range": on_fact(explore.order_date_range, "order_date"),
        "e04_birthdate_range": on_customers(explore.birthdate_range, as_of=AS_OF),
        "e05_total_sales": on_fact(explore.total_sales, "sales_amount"),
        "e06_total_quantity": on_fact(explore.total_quantity, "quantity"),
        "e07_average_price": on_fact(explore.average_price, "price"),
        "e07_average_price_exact": on_fact(explore.average_price, "price", exact=True),
        "e08_order_lines": on_fact(explore.order_lines, "order_number"),
        "e09_distinct_orders": on_fact(explore.distinct_orders, "order_number"),
        "e10_product_count": on_products(explore.product_count),
        "e11_customer_count": on_customers(explore.customer_count),
        "e12_ordering_customers": on_fact(explore.ordering_customers, "customer_key"),
        "e13_key_metrics": lambda spark, d: explore.key_metrics(
            fact_sales(spark, d, "sales_amount", "quantity", "price", "order_number"),
            dim_products(spark, d), dim_customers(spark, d)),
        "e14_customers_by_country": on_customers(explore.customers_by_country),
        "e15_customers_by_gender": on_customers(explore.customers_by_gender),
        "e16_products_by_category": on_products(explore.products_by_category),
        "e17_average_cost_by_category": on_products(explore.average_cost_by_category),
        "e17_average_cost_by_category_exact": on_products(explore.average_cost_by_category, exact=True),
        "e18_revenue_by_category": fact_by_product(
            explore.revenue_by_category, "product_key", "sales_amount"),
        "e18_revenue_by_category_dirty_keys": fact_by_product(
            explore.revenue_by_category, "product_key", "sales_amount", fact=dirty_fact_sales),
        "e19_revenue_by_customer": fact_by_customer(
            explore.revenue_by_customer, "customer_key", "sales_amount"),
        "e19_revenue_by_customer_dirty_keys": fact_by_customer(
            explore.revenue_by_customer, "customer_key", "sales_amount", fact=dirty_fact_sales),
        "e20_items_by_country": fact_by_customer(explore.items_by_country, "customer_key", "quantity"),
        "e21_top_products": fact_by_product(ranking.top_products, "product_key", "sales_amount"),
        "e22_ranked_products": fact_by_product(ranking.ranked_products, "product_key", "sales_amount"),
        "e23_bottom_products": fact_by_product(ranking.bottom_products, "product_key", "sales_amount"),
        "e24_top_customers": fact_by_customer(ranking.top_customers, "customer_key", "sales_amount"),
        "e24_top_customers_dirty_keys": fact_by_customer(
            ranking.top_customers, "customer_key", "sales_amount", fact=dirty_fact_sales),
        "e25_fewest_orders": fact_by_customer(ranking.fewest_orders, *order_lines, keys_verified=True),
        "e25_fewest_orders_dirty_keys": fact_by_customer(
            ranking.fewest_orders, *order_lines, fact=dirty_fact_sales, n=10),
        "e26_activity_by_year_month": on_fact(
            trend.activity_by_year_month, "order_date", "sales_amount", "customer_key", "quantity"),
        "e27_activity_by_month_start": on_fact(
            trend.activity_by_month_start, "order_date", "sales_amount", "customer_key", "quantity"),
        "e28_activity_by_month_text": on_fact(
            trend.activity_by_month_text, "order_date", "sales_amount", "customer_key", "quantity"),
        "e29_running_totals": on_fact(trend.running_totals, "order_date", "sales_amount", "price"),
        "e29_running_totals_monthly": on_fact(
            trend.running_totals, "order_date", "sales_amount", "price", grain="month"),
        "e29_running_totals_exact": on_fact(
            trend.running_totals, "order_date", "sales_amount", "price", exact=True),
        "e30_product_performance": fact_by_product(
            trend.product_performance, "order_date", "product_key", "sales_amount"),
        "e30_product_performance_dirty_keys": fact_by_product(
            trend.product_performance, "order_date", "product_key", "sales_amount", fact=dirty_fact_sales),
        "e31_products_by_cost_band": on_products(segments.products_by_cost_band),
        "e32_customers_by_segment": fact_by_customer(
            segments.customers_by_segment, "customer_key", "order_date", "sales_amount"),
        "e32_customers_by_segment_high_spend": fact_by_customer(
            segments.customers_by_segment, "customer_key", "order_date", "sales_amount", limit=HIGH_SPEND),
        "e33_category_shares": fact_by_product(trend.category_shares, "product_key", "sales_amount"),
        "e34_report_customers": fact_by_customer(
            reports.report_customers, as_of=AS_OF, keys_verified=True),
        "e34_report_customers_high_spend": REPORTS["customers"],
        "e34_report_customers_as_written": fact_by_customer(
            reports.report_customers, as_of=AS_OF, as_written=True, keys_verified=True),
        "e34_report_customers_dirty_keys": fact_by_customer(
            reports.report_customers, as_of=AS_OF, fact=dirty_fact_sales),
        "e35_report_products": REPORTS["products"],
        "e35_report_products_dirty_keys": fact_by_product(
            reports.report_products, as_of=AS_OF, fact=dirty_fact_sales),
    }


def _dashboard_queries() -> dict[str, Query]:
    amounts = ("sales_amount", "profit", "quantity", "order_number", "customer_key")
    card_columns = ("category", "country", "order_year", "order_date", "is_returning",
                    "customer_key", "order_number", "sales_amount", "profit")
    snapshot_columns = (*amounts, "category", "customer_segment", "order_year", "country", "product_name")
    return {
        "f01_kpis": on_headline(headline),
        "f01_kpis_of_frame": on_sales(insights.kpis, *amounts),
        "f01_kpis_slice": on_headline(headline, **SLICE),
        "f01_kpis_slice_of_frame": lambda spark, d: insights.kpis(sales_slice(spark, d)),
        "f01_kpis_no_sales": on_headline(headline, date_range=NO_DATES),
        "f01b_revenue_per_customer": on_sales(
            insights.revenue_per_customer, "sales_amount", "customer_key"),
        "f02_category_concentration": on_sales(
            insights.category_concentration, "category", "sales_amount"),
        "f03_margin_opportunity": on_sales(
            insights.margin_opportunity, "category", "sales_amount", "profit"),
        "f04_repeat_customer_value": on_sales(
            insights.repeat_customer_value, "customer_key", "order_number", "sales_amount"),
        "f04_repeat_customer_value_dirty_keys": on_sales(
            insights.repeat_customer_value, "customer_key", "order_number", "sales_amount", dirty=True),
        "f05_returning_growth": on_sales(
            insights.returning_growth, "order_year", "is_returning", "sales_amount"),
        "f06_market_concentration": on_sales(insights.market_concentration, "country", "sales_amount"),
        "f07_seasonality": on_sales(insights.seasonality, "order_date", "sales_amount"),
        "f08_all_insights": on_star_parts(insights.cards_of),
        "f08_all_insights_slice": on_star_parts(insights.cards_of, **SLICE),
        "f08_all_insights_no_sales": on_star_parts(insights.cards_of, date_range=NO_DATES),
        "f08_all_insights_slice_of_frame": lambda spark, d: insights.all_insights(saved(
            spark, sales_slice(spark, d).select(*card_columns))),
        "g01_monthly_trend": on_sales(frames.monthly_trend, "order_month", "sales_amount"),
        "g02_yearly_revenue": on_sales(frames.yearly_revenue, "order_year", "sales_amount"),
        "g03_category_share": on_sales(frames.category_share, "category", "sales_amount"),
        "g04_new_vs_returning": on_sales(
            frames.new_vs_returning, "order_year", "is_returning", "sales_amount"),
        "g05_revenue_by_calendar_month": on_sales(
            frames.revenue_by_calendar_month, "order_date", "sales_amount"),
        "g05_revenue_by_calendar_month_gaps": lambda spark, d: frames.revenue_by_calendar_month(
            sales_model.apply_filters(
                sales_frame(spark, d, "order_date", "sales_amount"),
                (dt.date(1997, 3, 1), dt.date(1997, 8, 31)))),
        "g06_top_subcategories": on_sales(frames.top_subcategories, "subcategory", "sales_amount"),
        "g07_margin_by_category": on_sales(frames.margin_by_category, "category", "sales_amount", "profit"),
        "g08_top_products": on_sales(frames.top_products, "product_name", "sales_amount"),
        "g09_cost_segmentation": on_sales(frames.cost_segmentation, "product_key", "cost"),
        "g09_cost_segmentation_no_sales": lambda spark, d: frames.cost_segmentation(no_sales(spark, d)),
        "g10_segment_split": on_sales(
            frames.segment_split, "customer_segment", "customer_key", "sales_amount"),
        "g11_age_groups": on_sales(frames.age_groups, "age_group", "sales_amount"),
        "g12_top_countries": on_sales(frames.top_countries, "country", "sales_amount"),
        "h01_kpi_figures": on_headline(lambda parts: headline(parts).drop("items_per_order")),
        "h01_kpi_figures_of_frame": on_sales(snapshot.kpi_figures, *amounts),
        "h02_category_figures": on_sales(snapshot.category_figures, "category", "sales_amount", "profit"),
        "h03_segment_figures": on_sales(
            snapshot.segment_figures, "customer_segment", "customer_key", "sales_amount"),
        "h04_top_countries": on_sales(
            snapshot.top_figures, "country", "sales_amount", column="country"),
        "h05_snapshot": on_star_parts(snapshot.snapshot_of),
        "h05_snapshot_slice": on_star_parts(snapshot.snapshot_of, **SLICE),
        "h05_snapshot_no_sales": on_star_parts(snapshot.snapshot_of, date_range=NO_DATES),
        "h05_snapshot_lines": on_star_parts(snapshot.lines_of, **SLICE),
        "h05_snapshot_slice_of_frame": lambda spark, d: snapshot.snapshot(saved(
            spark, sales_slice(spark, d).select(*snapshot_columns))),
        "h05_snapshot_lines_no_sales": on_star_parts(snapshot.lines_of, date_range=NO_DATES),
    }


def _quality_queries() -> dict[str, Query]:
    def tables(fact: Callable) -> Callable:
        return lambda spark, d: {
            "fact_sales": fact(spark, d, "order_number"), "dim_products": dim_products(spark, d)}

    return {
        "q01_null_counts": lambda spark, d: quality.null_counts(
            dirty_fact_sales(spark, d), ["product_key", "customer_key", "order_date", "order_number"]),
        "q01_measures_observed_while_written": observed_measures,
        "q02_orphan_customers": fact_by_customer(
            quality.orphan_keys, "customer_key", fact=dirty_fact_sales, key="customer_key"),
        "q02_orphan_products": fact_by_product(
            quality.orphan_keys, "product_key", fact=dirty_fact_sales, key="product_key"),
        "q03_join_coverage": on_sales(
            lambda s: quality.join_coverage(s, ["category", "country", "cost"]),
            "category", "country", "cost", dirty=True),
        "q04_duplicate_keys": on_raw(
            raw.crm_cust_info, lambda r: quality.duplicate_keys(r, "cst_key")),
        "q05_row_count_match": lambda spark, d: quality.row_count_match(
            tables(fact_sales)(spark, d), tables(dirty_fact_sales)(spark, d)),
        "q06_revenue_reconciliation": lambda spark, d: quality.revenue_reconciliation(
            sales_frame(spark, d, "sales_amount"), fact_sales(spark, d, "sales_amount")),
        "q07_kpi_sanity": on_sales(
            quality.kpi_sanity, "sales_amount", "profit", "quantity", "order_number", "customer_key"),
    }


def queries() -> dict[str, Query]:
    """Every operator as a query of (spark, sf_dir)."""
    return {
        **_source_queries(), **_silver_queries(), **_gold_queries(), **_model_queries(),
        **_script_queries(), **_dashboard_queries(), **_quality_queries(),
        **(llm.queries() if llm else {}),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the same result per query."""
    return {**oracle.statements(), **(llm.oracle_sql() if llm else {})}
