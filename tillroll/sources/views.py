"""Report views that outlive the session: SQL over the stored star, kept in the catalog.

A view holds a query and no rows. Whoever shares the catalog reads the report as the tables are then,
ages and recency as of the day of reading. The queries follow ``operators/reports.py``, which
tests compare them with. Facts stored by this package have no dangling keys, as the views assume.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from tillroll.operators import labels


def _months(start: str, end: str) -> str:
    return f"((year({end}) - year({start})) * 12 + month({end}) - month({start}))"


def _day(as_of: dt.date | None) -> str:
    return f"DATE '{as_of.isoformat()}'" if as_of else "current_date()"


def _totals(fact: str, key: str, other: str) -> str:
    """Sums, dates and distinct orders and partners by key, each count from a narrow first step."""
    return f"""
    SELECT {key}, sum(n_order) AS total_orders, sum(sales) AS total_sales, sum(units) AS total_quantity,
           sum(n_other) AS total_others, min(first_date) AS first_date, max(last_date) AS last_date,
           try_divide(sum(price_sum), sum(price_count)) AS unit_price
    FROM (
        SELECT {key}, CAST(order_number IS NOT NULL AS BIGINT) AS n_order, sum(sales_amount) AS sales,
               sum(quantity) AS units, CAST(0 AS BIGINT) AS n_other, min(order_date) AS first_date, max(order_date) AS last_date,
               sum(sales_amount / nullif(quantity, 0)) AS price_sum, count(sales_amount / nullif(quantity, 0)) AS price_count
        FROM {fact} WHERE order_date IS NOT NULL GROUP BY {key}, order_number
        UNION ALL
        SELECT {key}, 0, NULL, NULL, CAST({other} IS NOT NULL AS BIGINT), NULL, NULL, NULL, NULL
        FROM (SELECT DISTINCT {key}, {other} FROM {fact} WHERE order_date IS NOT NULL)
    ) GROUP BY {key}"""


def _segment(spend: int, months: int) -> str:
    return (f"CASE WHEN lifespan >= {months} AND total_sales > {spend} THEN '{labels.VIP}' "
            f"WHEN lifespan >= {months} AND total_sales <= {spend} THEN '{labels.REGULAR}' ELSE '{labels.NEW}' END")


def customers_query(fact: str, customers: str, as_of: dt.date | None = None, segment_months: int = labels.SEGMENT_MONTHS,
                    segment_spend: int = labels.SEGMENT_SPEND) -> str:
    """The customer report over two tables, given by what stands after FROM."""
    day = _day(as_of)
    ages = " ".join(f"WHEN age < {below} THEN '{name}'" for below, name in labels.AGE_GROUPS)
    return f"""
WITH totals AS ({_totals(fact, "customer_key", "product_key")}
), spans AS (
    SELECT *, {_months("first_date", "last_date")} AS lifespan FROM totals
), people AS (
    SELECT customer_key AS known_key, customer_number, year({day}) - year(birthdate) AS age,
           concat(coalesce(first_name, ''), ' ', coalesce(last_name, '')) AS customer_name
    FROM {customers}
)
SELECT customer_key, customer_number, coalesce(customer_name, ' ') AS customer_name, age,
       CASE {ages} ELSE '{labels.OLDEST_GROUP}' END AS age_group, {_segment(segment_spend, segment_months)} AS customer_segment,
       last_date AS last_order_date, {_months("last_date", day)} AS recency, total_orders, total_sales, total_quantity,
       total_others AS total_products, lifespan,
       CASE WHEN total_sales = 0 THEN 0 ELSE total_sales div nullif(total_orders, 0) END AS avg_order_value,
       CASE WHEN lifespan = 0 THEN total_sales ELSE total_sales div nullif(lifespan, 0) END AS avg_monthly_spend
FROM spans LEFT JOIN people ON customer_key = known_key"""


def products_query(fact: str, products: str, as_of: dt.date | None = None, limits: tuple = labels.PRODUCT_LIMITS) -> str:
    """The product report over two tables, given by what stands after FROM."""
    top, middle, bottom = labels.PRODUCT_SEGMENTS
    return f"""
WITH totals AS ({_totals(fact, "product_key", "customer_key")}
), spans AS (
    SELECT *, {_months("first_date", "last_date")} AS lifespan FROM totals
), known AS (
    SELECT product_key AS known_key, product_name, category, subcategory, cost FROM {products}
)
SELECT product_key, product_name, category, subcategory, cost, last_date AS last_sale_date,
       {_months("last_date", _day(as_of))} AS recency_in_months,
       CASE WHEN total_sales > {limits[0]} THEN '{top}' WHEN total_sales >= {limits[1]} THEN '{middle}'
            ELSE '{bottom}' END AS product_segment,
       lifespan, total_orders, total_sales, total_quantity, total_others AS total_customers,
       round(unit_price, 1) AS avg_selling_price,
       CASE WHEN total_orders = 0 THEN 0 ELSE total_sales div nullif(total_orders, 0) END AS avg_order_revenue,
       CASE WHEN lifespan = 0 THEN total_sales ELSE total_sales div nullif(lifespan, 0) END AS avg_monthly_revenue
FROM spans LEFT JOIN known ON product_key = known_key"""


def stored_at(path: str) -> str:
    """A stored Parquet table as it stands after FROM."""
    if "`" in path:
        raise ValueError(f"a path with a back quote cannot be named in a view: {path}")
    return f"parquet.`{path}`"


def create_view(spark: SparkSession, name: str, query: str) -> DataFrame:
    """Drop the catalog's view of that name if there is one, create it, and return what it shows."""
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    spark.sql(f"CREATE VIEW {name} AS {query}")
    return spark.table(name)


def publish_report_views(
    spark: SparkSession, paths: dict[str, str], customers_view: str = "report_customers",
    products_view: str = "report_products", as_of: dt.date | None = None, segment_spend: int = labels.SEGMENT_SPEND,
) -> dict[str, DataFrame]:
    """Both report views over the star tables stored at ``paths``; create them anew after each publication."""
    fact = stored_at(paths["fact_sales"])
    return {
        customers_view: create_view(spark, customers_view, customers_query(
            fact, stored_at(paths["dim_customers"]), as_of, segment_spend=segment_spend)),
        products_view: create_view(spark, products_view, products_query(fact, stored_at(paths["dim_products"]), as_of)),
    }
