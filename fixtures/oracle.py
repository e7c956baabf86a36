"""DuckDB SQL for every query, written from the operator definitions."""

from __future__ import annotations

from fixtures import bronze, star

AS_OF = "DATE '2001-12-31'"
AS_OF_YEAR, AS_OF_MONTHS = 2001, 2001 * 12 + 12
SLICE = """order_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'
  AND category IN ('ECONOMY', 'LARGE', 'PROMO')
  AND country IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_5', 'NATION_8')
  AND customer_segment IN ('VIP', 'Regular')"""


def on_star(body: str, *more: str) -> str:
    """A statement over the star tables, with further common table expressions."""
    return "WITH " + ",\n".join([star.SQL, *more]) + "\n" + body


# --- Bronze, Silver, Gold ------------------------------------------------------------------

# every character Python strips, as DuckDB sees it
SPACES = "||".join(f"chr({n})" for n in (
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))


def strip(c: str) -> str:
    return f"trim({c}, {SPACES})"


def iso(c: str) -> str:
    return f"CAST(try_strptime({c}, '%Y-%m-%d') AS DATE)"


def in_span(d: str) -> str:
    return f"CASE WHEN {d} BETWEEN DATE '1677-09-22' AND DATE '2262-04-11' THEN {d} END"


def number(c: str) -> str:
    return f"TRY_CAST({strip(c)} AS DOUBLE)"


def compact(c: str) -> str:
    return (f"CASE WHEN regexp_full_match({strip(c)}, '[0-9]{{8}}') "
            f"THEN CAST(try_strptime({strip(c)}, '%Y%m%d') AS DATE) END")


MARITAL = f"CASE upper({strip('cst_marital_status')}) WHEN 'M' THEN 'Married' WHEN 'S' THEN 'Single' ELSE 'n/a' END"
GENDER = f"CASE upper({strip('cst_gndr')}) WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' ELSE 'n/a' END"
LINE = (f"CASE upper({strip('prd_line')}) WHEN 'M' THEN 'Mountain' WHEN 'R' THEN 'Road' "
        "WHEN 'S' THEN 'Other Sales' WHEN 'T' THEN 'Touring' ELSE 'n/a' END")
ERP_GENDER = (f"CASE WHEN upper({strip('gen')}) IN ('F', 'FEMALE') THEN 'Female' "
              f"WHEN upper({strip('gen')}) IN ('M', 'MALE') THEN 'Male' ELSE 'n/a' END")
ERP_KEY = strip("CASE WHEN starts_with(cid, 'NAS') THEN substr(cid, 4) ELSE cid END")
BIRTH = f"CASE WHEN {iso('bdate')} <= {AS_OF} THEN {in_span(iso('bdate'))} END"
COUNTRY = (f"CASE {strip('cntry')} WHEN 'DE' THEN 'Germany' WHEN 'US' THEN 'United States' "
           f"WHEN 'USA' THEN 'United States' WHEN '' THEN 'n/a' ELSE {strip('cntry')} END")
COST = f"CAST(trunc(coalesce({number('prd_cost')}, 0)) AS BIGINT)"

SILVER = f"""
s_customers AS (
  SELECT cst_id, cst_key, cst_firstname, cst_lastname, cst_marital_status, cst_gndr, cst_create_date
  FROM (
    SELECT CAST({strip('cst_id')} AS BIGINT) AS cst_id, cst_key,
           {strip('cst_firstname')} AS cst_firstname, {strip('cst_lastname')} AS cst_lastname,
           {MARITAL} AS cst_marital_status, {GENDER} AS cst_gndr, {iso('cst_create_date')} AS cst_create_date
    FROM crm_cust_info WHERE {strip('cst_id')} <> '')
  QUALIFY row_number() OVER (PARTITION BY cst_id ORDER BY cst_create_date DESC NULLS FIRST) = 1
),
s_products AS (
  SELECT prd_id, substr(prd_key, 7) AS prd_key, {strip('prd_nm')} AS prd_nm, {COST} AS prd_cost,
         {LINE} AS prd_line, {iso('prd_start_dt')} AS prd_start_dt, {iso('prd_end_dt')} AS prd_end_dt,
         replace(substr(prd_key, 1, 5), '-', '_') AS cat_id
  FROM crm_prd_info
),
s_parsed AS (
  SELECT sls_ord_num, sls_prd_key, sls_cust_id, {compact('sls_order_dt')} AS sls_order_dt,
         {compact('sls_ship_dt')} AS sls_ship_dt, {compact('sls_due_dt')} AS sls_due_dt,
         {number('sls_sales')} AS sales, {number('sls_quantity')} AS qty, {number('sls_price')} AS price
  FROM crm_sales_details
),
s_amounts AS (
  SELECT *,
         CASE WHEN sales IS NULL OR sales <= 0 OR price IS NULL OR qty IS NULL OR sales <> qty * abs(price)
              THEN qty * abs(price) ELSE sales END AS sales2,
         CASE WHEN sales > 0 AND (price IS NULL OR qty IS NULL) THEN sales
              WHEN sales IS NULL OR sales <= 0 OR sales <> qty * abs(price)
              THEN qty * abs(price) ELSE sales END AS lenient
  FROM s_parsed
),
s_sales AS (
  SELECT *, CASE WHEN price IS NULL OR price <= 0
                 THEN CASE WHEN qty <> 0 THEN sales2 / qty END ELSE price END AS price2
  FROM s_amounts
),
s_details AS (
  SELECT sls_ord_num, sls_prd_key, sls_cust_id, sls_order_dt, sls_ship_dt, sls_due_dt,
         CAST(sales2 AS BIGINT) AS sls_sales, CAST(round_even(qty, 0) AS BIGINT) AS sls_quantity,
         CAST(round_even(price2, 0) AS BIGINT) AS sls_price
  FROM s_sales
),
s_people AS (SELECT {ERP_KEY} AS cid, {BIRTH} AS bdate, {ERP_GENDER} AS gen FROM erp_cust_az12),
s_places AS (SELECT {strip("replace(cid, '-', '')")} AS cid, {COUNTRY} AS cntry FROM erp_loc_a101),
s_categories AS (
  SELECT {strip('id')} AS id, {strip('cat')} AS cat, {strip('subcat')} AS subcat,
         {strip('maintenance')} AS maintenance
  FROM erp_px_cat_g1v2
)"""

GOLD = """
g_customers AS (
  SELECT row_number() OVER (ORDER BY cst_id) AS customer_key, cst_id AS customer_id,
         cst_key AS customer_number, cst_firstname AS first_name, cst_lastname AS last_name,
         coalesce(cntry, 'n/a') AS country, cst_marital_status AS marital_status,
         CASE WHEN cst_gndr <> 'n/a' THEN cst_gndr ELSE coalesce(gen, 'n/a') END AS gender,
         bdate AS birthdate, cst_create_date AS create_date
  FROM s_customers
  LEFT JOIN s_people ON cst_key = s_people.cid
  LEFT JOIN s_places ON cst_key = s_places.cid
),
g_products AS (
  SELECT row_number() OVER (ORDER BY product_id) AS product_key, *
  FROM (
    SELECT CAST(prd_id AS BIGINT) AS product_id, prd_key AS product_number, prd_nm AS product_name,
           cat_id AS category_id, cat AS category, subcat AS subcategory, maintenance,
           prd_cost AS cost, prd_line AS product_line, prd_start_dt AS start_date
    FROM (SELECT * FROM s_products
          QUALIFY row_number() OVER (PARTITION BY prd_key
            ORDER BY prd_start_dt DESC NULLS FIRST, CAST(prd_id AS BIGINT) DESC) = 1)
    LEFT JOIN s_categories ON cat_id = id)
),
g_sales AS (
  SELECT sls_ord_num AS order_number, product_key, customer_key, sls_order_dt AS order_date,
         sls_ship_dt AS shipping_date, sls_due_dt AS due_date, sls_sales AS sales_amount,
         sls_quantity AS quantity, sls_price AS price
  FROM s_details
  LEFT JOIN g_products ON sls_prd_key = product_number
  LEFT JOIN g_customers ON CAST(TRY_CAST(sls_cust_id AS DOUBLE) AS BIGINT) = customer_id
)"""


def on_raw(body: str) -> str:
    return "WITH " + ",\n".join([bronze.SQL, SILVER, GOLD]) + "\n" + body


KEY_SUMMARY = on_raw(" UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS row_count, CAST(sum({key}) AS BIGINT) AS key_sum FROM {source}"
    for name, key, source in (
        ("dim_customers", "customer_key", "g_customers"),
        ("dim_products", "product_key", "g_products"),
        ("fact_sales", "customer_key", "g_sales"))))


def warehouse() -> dict[str, str]:
    return {
        "a01_read_bronze_csv": on_raw("SELECT * FROM crm_cust_info"),
        "b01_identified_customers": on_raw(
            f"SELECT CAST({strip('cst_id')} AS BIGINT) AS cst_id, cst_key FROM crm_cust_info "
            f"WHERE {strip('cst_id')} <> ''"),
        "b02_trimmed_names": on_raw(
            f"SELECT cst_key, {strip('cst_firstname')} AS cst_firstname, "
            f"{strip('cst_lastname')} AS cst_lastname FROM crm_cust_info"),
        "b03_marital_labels": on_raw(f"SELECT cst_key, {MARITAL} AS marital_status FROM crm_cust_info"),
        "b04_gender_labels": on_raw(f"SELECT cst_key, {GENDER} AS gender FROM crm_cust_info"),
        "b05_create_dates": on_raw(f"SELECT cst_key, {iso('cst_create_date')} AS create_date FROM crm_cust_info"),
        "b06_latest_customers": on_raw(
            "SELECT s.cst_id, r.cst_key, r.cst_firstname, r.cst_lastname, r.cst_marital_status, r.cst_gndr, "
            "s.cst_create_date FROM s_customers s JOIN crm_cust_info r "
            f"ON {strip('r.cst_id')} = CAST(s.cst_id AS VARCHAR) "
            f"AND {iso('r.cst_create_date')} IS NOT DISTINCT FROM s.cst_create_date"),
        "b07_clean_crm_cust_info": on_raw("SELECT * FROM s_customers"),
        "b08_product_key_split": on_raw("SELECT prd_id, cat_id, prd_key AS product_number FROM s_products"),
        "b09_product_costs": on_raw("SELECT prd_id, prd_cost AS cost FROM s_products"),
        "b10_product_lines": on_raw("SELECT prd_id, prd_line AS product_line FROM s_products"),
        "b11_product_names_and_dates": on_raw("SELECT prd_id, prd_nm, prd_start_dt, prd_end_dt FROM s_products"),
        "b12_clean_crm_prd_info": on_raw("SELECT * FROM s_products"),
        "b13_compact_dates": on_raw(
            f"SELECT sls_ord_num, sls_order_dt, {compact('sls_order_dt')} AS order_date FROM crm_sales_details"),
        "b14_repaired_sales": on_raw("SELECT sls_ord_num, sls_prd_key, sales2 AS sales FROM s_sales"),
        "b14_repaired_sales_lenient": on_raw("SELECT sls_ord_num, sls_prd_key, lenient AS sales FROM s_sales"),
        "b15_repaired_prices": on_raw(
            "SELECT sls_ord_num, sls_prd_key, round_even(price2, 0) AS price FROM s_sales"),
        "b16_clean_crm_sales_details": on_raw("SELECT * FROM s_details"),
        "b17_erp_customer_keys": on_raw("SELECT cid FROM s_people"),
        "b18_past_birthdates": on_raw(f"SELECT cid, {BIRTH} AS birthdate FROM erp_cust_az12"),
        "b19_erp_gender_labels": on_raw(f"SELECT cid, {ERP_GENDER} AS gender FROM erp_cust_az12"),
        "b20_clean_erp_cust_az12": on_raw("SELECT * FROM s_people"),
        "b21_clean_erp_loc_a101": on_raw("SELECT * FROM s_places"),
        "b22_clean_erp_px_cat": on_raw("SELECT * FROM s_categories"),
        "c01_dim_customers": on_raw("SELECT * FROM g_customers"),
        "c02_preferred_gender": on_raw("SELECT customer_id, gender FROM g_customers"),
        "c03_customer_country": on_raw("SELECT customer_id, country FROM g_customers"),
        "c04_dense_keys": on_star(
            "SELECT row_number() OVER (ORDER BY customer_id) AS customer_key, customer_id FROM dim_customers"),
        "c05_dim_products": on_raw("SELECT * FROM g_products"),
        "c06_fact_sales": on_raw("SELECT * FROM g_sales"),
        "c07_gold_tables": KEY_SUMMARY,
        "a08_write_warehouse": KEY_SUMMARY,
        "a08_published_customers": on_raw("SELECT * FROM g_customers"),
        "a08_published_products": on_raw("SELECT * FROM g_products"),
        "a08_published_fact": on_raw("SELECT * FROM g_sales"),
        "c08_bronze_to_gold_revenue": on_raw(
            "SELECT category, CAST(sum(sales_amount) AS BIGINT) AS total_revenue "
            "FROM g_sales LEFT JOIN g_products USING (product_key) GROUP BY category"),
        "q04_duplicate_keys": on_raw(
            "SELECT cst_key, count(*) AS copies FROM crm_cust_info GROUP BY cst_key HAVING count(*) > 1"),
    }


# --- analysis scripts ----------------------------------------------------------------------

def months(a: str, b: str) -> str:
    return f"CAST(date_diff('month', {a}, {b}) AS INTEGER)"


def years(a: str, b: str) -> str:
    return f"CAST(date_diff('year', {a}, {b}) AS INTEGER)"


def total(c: str) -> str:
    return f"CAST(sum({c}) AS BIGINT)"


def int_mean(c: str) -> str:
    return f"CAST(sum({c}) // count({c}) AS BIGINT)"


def exact_mean(c: str) -> str:
    return f"CAST(sum({c}) AS DOUBLE) / count({c})"


PRODUCT_JOIN = "LEFT JOIN dim_products p ON p.product_key = f.product_key"
CUSTOMER_JOIN = "LEFT JOIN dim_customers c ON c.customer_key = f.customer_key"


def activity(period: str, groups: str) -> str:
    return on_star(
        f"SELECT {period}, {total('sales_amount')} AS total_sales, count(DISTINCT customer_key) AS total_customers, "
        f"{total('quantity')} AS total_quantity FROM fact_sales WHERE order_date IS NOT NULL GROUP BY {groups}")


def running(grain: str, exact: bool = False) -> str:
    if exact:
        price, moving = exact_mean("price"), "avg(avg_price) OVER so_far"
    else:
        price, moving = int_mean("price"), "CAST(sum(avg_price) OVER so_far // count(avg_price) OVER so_far AS BIGINT)"
    return on_star(
        "SELECT order_date, total_sales, CAST(sum(total_sales) OVER so_far AS BIGINT) AS running_total_sales, "
        f"{moving} AS moving_average_price "
        f"FROM (SELECT CAST(date_trunc('{grain}', order_date) AS DATE) AS order_date, "
        f"{total('sales_amount')} AS total_sales, {price} AS avg_price "
        "FROM fact_sales WHERE order_date IS NOT NULL GROUP BY 1) WINDOW so_far AS (ORDER BY order_date)")


def performance(fact: str) -> str:
    return on_star(f"""
SELECT order_year, product_name, current_sales, avg_sales, current_sales - avg_sales AS diff_avg,
       CASE WHEN current_sales > avg_sales THEN 'Above Avg' WHEN current_sales < avg_sales THEN 'Below Avg'
            ELSE 'Avg' END AS avg_change,
       py_sales, current_sales - py_sales AS diff_py,
       CASE WHEN current_sales > py_sales THEN 'Increase' WHEN current_sales < py_sales THEN 'Decrease'
            ELSE 'No Change' END AS py_change
FROM (
  SELECT *, CAST(sum(current_sales) OVER (PARTITION BY product_name)
                 // count(current_sales) OVER (PARTITION BY product_name) AS BIGINT) AS avg_sales,
         lag(current_sales) OVER (PARTITION BY product_name ORDER BY order_year) AS py_sales
  FROM (
    SELECT CAST(year(order_date) AS INTEGER) AS order_year, product_name, {total('sales_amount')} AS current_sales
    FROM {fact} f {PRODUCT_JOIN} WHERE order_date IS NOT NULL GROUP BY 1, 2))""")


def segment(lifespan: str, spend: str, limit: int) -> str:
    return (f"CASE WHEN {lifespan} >= 12 AND {spend} > {limit} THEN 'VIP' "
            f"WHEN {lifespan} >= 12 AND {spend} <= {limit} THEN 'Regular' ELSE 'New' END")


def customers_by_segment(limit: int) -> str:
    return on_star(f"""
SELECT customer_segment, count(customer_key) AS total_customers
FROM (
  SELECT customer_key, {segment('lifespan', 'spend', limit)} AS customer_segment
  FROM (SELECT c.customer_key, sum(sales_amount) AS spend,
               {months('min(order_date)', 'max(order_date)')} AS lifespan
        FROM fact_sales f {CUSTOMER_JOIN} GROUP BY 1))
GROUP BY 1""")


AGE_GROUP = ("CASE WHEN age < 20 THEN 'Under 20' WHEN age BETWEEN 20 AND 29 THEN '20-29' "
             "WHEN age BETWEEN 30 AND 39 THEN '30-39' WHEN age BETWEEN 40 AND 49 THEN '40-49' "
             "ELSE '50 and above' END")


def customer_report(fact: str, limit: int) -> str:
    """The body of a common table expression."""
    return f"""
  SELECT customer_key, customer_number, customer_name, age, {AGE_GROUP} AS age_group,
         {segment('lifespan', 'total_sales', limit)} AS customer_segment,
         last_order_date, {months('last_order_date', AS_OF)} AS recency,
         total_orders, total_sales, total_quantity, total_products, lifespan,
         CASE WHEN total_sales = 0 THEN 0 ELSE total_sales // total_orders END AS avg_order_value,
         CASE WHEN lifespan = 0 THEN total_sales ELSE total_sales // lifespan END AS avg_monthly_spend
  FROM (
    SELECT c.customer_key, c.customer_number,
           coalesce(first_name, '') || ' ' || coalesce(last_name, '') AS customer_name,
           {years('birthdate', AS_OF)} AS age,
           count(DISTINCT order_number) AS total_orders, {total('sales_amount')} AS total_sales,
           {total('quantity')} AS total_quantity, count(DISTINCT product_key) AS total_products,
           max(order_date) AS last_order_date, {months('min(order_date)', 'max(order_date)')} AS lifespan
    FROM {fact} f {CUSTOMER_JOIN} WHERE order_date IS NOT NULL GROUP BY 1, 2, 3, 4)"""


def product_report(fact: str) -> str:
    return f"""
  SELECT product_key, product_name, category, subcategory, cost, last_sale_date,
         {months('last_sale_date', AS_OF)} AS recency_in_months,
         CASE WHEN total_sales > 50000 THEN 'High-Performer' WHEN total_sales >= 10000 THEN 'Mid-Range'
              ELSE 'Low-Performer' END AS product_segment,
         lifespan, total_orders, total_sales, total_quantity, total_customers, avg_selling_price,
         CASE WHEN total_orders = 0 THEN 0 ELSE total_sales // total_orders END AS avg_order_revenue,
         CASE WHEN lifespan = 0 THEN total_sales ELSE total_sales // lifespan END AS avg_monthly_revenue
  FROM (
    SELECT p.product_key, product_name, category, subcategory, cost,
           {months('min(order_date)', 'max(order_date)')} AS lifespan, max(order_date) AS last_sale_date,
           count(DISTINCT order_number) AS total_orders, count(DISTINCT customer_key) AS total_customers,
           {total('sales_amount')} AS total_sales, {total('quantity')} AS total_quantity,
           round(avg(CAST(sales_amount AS DOUBLE) / nullif(quantity, 0)), 1) AS avg_selling_price
    FROM {fact} f {PRODUCT_JOIN} WHERE order_date IS NOT NULL GROUP BY 1, 2, 3, 4, 5)"""


def grouped(measure: str, name: str, by: str, source: str) -> str:
    return on_star(f"SELECT {by}, {measure} AS {name} FROM {source} GROUP BY ALL")


def customer_revenue(fact: str, tail: str = "") -> str:
    return on_star(
        f"SELECT c.customer_key, c.first_name, c.last_name, {total('sales_amount')} AS total_revenue "
        f"FROM {fact} f {CUSTOMER_JOIN} GROUP BY ALL {tail}")


def fewest_orders(fact: str, n: int) -> str:
    return on_star(
        "SELECT c.customer_key, c.first_name, c.last_name, count(DISTINCT order_number) AS total_orders "
        f"FROM {fact} f {CUSTOMER_JOIN} GROUP BY ALL "
        f"ORDER BY total_orders, c.customer_key NULLS FIRST LIMIT {n}")


def scripts() -> dict[str, str]:
    revenue_by_category = f"fact_sales f {PRODUCT_JOIN}"
    product_revenue = (f"SELECT product_name, {total('sales_amount')} AS total_revenue "
                       f"FROM fact_sales f {PRODUCT_JOIN} GROUP BY product_name")
    report = customer_report("fact_sales", star.HIGH_SPEND)
    products = product_report("fact_sales")
    return {
        "e01_customer_countries": on_star("SELECT DISTINCT country FROM dim_customers"),
        "e02_product_hierarchy": on_star("SELECT DISTINCT category, subcategory, product_name FROM dim_products"),
        "e03_order_date_range": on_star(
            "SELECT min(order_date) AS first_order_date, max(order_date) AS last_order_date, "
            f"{months('min(order_date)', 'max(order_date)')} AS order_range_months FROM fact_sales"),
        "e04_birthdate_range": on_star(
            f"SELECT min(birthdate) AS oldest_birthdate, {years('min(birthdate)', AS_OF)} AS oldest_age, "
            f"max(birthdate) AS youngest_birthdate, {years('max(birthdate)', AS_OF)} AS youngest_age "
            "FROM dim_customers"),
        "e05_total_sales": on_star(f"SELECT {total('sales_amount')} AS total_sales FROM fact_sales"),
        "e06_total_quantity": on_star(f"SELECT {total('quantity')} AS total_quantity FROM fact_sales"),
        "e07_average_price": on_star(f"SELECT {int_mean('price')} AS avg_price FROM fact_sales"),
        "e07_average_price_exact": on_star(f"SELECT {exact_mean('price')} AS avg_price FROM fact_sales"),
        "e08_order_lines": on_star("SELECT count(order_number) AS total_orders FROM fact_sales"),
        "e09_distinct_orders": on_star("SELECT count(DISTINCT order_number) AS total_orders FROM fact_sales"),
        "e10_product_count": on_star("SELECT count(product_name) AS total_products FROM dim_products"),
        "e11_customer_count": on_star("SELECT count(customer_key) AS total_customers FROM dim_customers"),
        "e12_ordering_customers": on_star("SELECT count(DISTINCT customer_key) AS total_customers FROM fact_sales"),
        "e13_key_metrics": on_star(
            f"SELECT 'Total Sales' AS measure_name, {total('sales_amount')} AS measure_value FROM fact_sales "
            f"UNION ALL SELECT 'Total Quantity', {total('quantity')} FROM fact_sales "
            f"UNION ALL SELECT 'Average Price', {int_mean('price')} FROM fact_sales "
            "UNION ALL SELECT 'Total Orders', count(DISTINCT order_number) FROM fact_sales "
            "UNION ALL SELECT 'Total Products', count(DISTINCT product_name) FROM dim_products "
            "UNION ALL SELECT 'Total Customers', count(customer_key) FROM dim_customers"),
        "e14_customers_by_country": grouped("count(customer_key)", "total_customers", "country", "dim_customers"),
        "e15_customers_by_gender": grouped("count(customer_key)", "total_customers", "gender", "dim_customers"),
        "e16_products_by_category": grouped("count(product_key)", "total_products", "category", "dim_products"),
        "e17_average_cost_by_category": grouped(int_mean("cost"), "avg_cost", "category", "dim_products"),
        "e17_average_cost_by_category_exact": grouped(exact_mean("cost"), "avg_cost", "category", "dim_products"),
        "e18_revenue_by_category": grouped(total("sales_amount"), "total_revenue", "category", revenue_by_category),
        "e18_revenue_by_category_dirty_keys": grouped(
            total("sales_amount"), "total_revenue", "category", f"dirty_{revenue_by_category}"),
        "e19_revenue_by_customer": customer_revenue("fact_sales"),
        "e19_revenue_by_customer_dirty_keys": customer_revenue("dirty_fact_sales"),
        "e20_items_by_country": grouped(
            total("quantity"), "total_sold_items", "country", f"fact_sales f {CUSTOMER_JOIN}"),
        "e21_top_products": on_star(
            f"{product_revenue} ORDER BY total_revenue DESC NULLS LAST, product_name NULLS FIRST LIMIT 5"),
        "e22_ranked_products": on_star(
            "SELECT * FROM (SELECT *, CAST(rank() OVER (ORDER BY total_revenue DESC NULLS LAST) AS INTEGER) "
            f"AS rank_products FROM ({product_revenue})) WHERE rank_products <= 5"),
        "e23_bottom_products": on_star(
            f"{product_revenue} ORDER BY total_revenue ASC NULLS FIRST, product_name NULLS FIRST LIMIT 5"),
        "e24_top_customers": customer_revenue(
            "fact_sales", "ORDER BY total_revenue DESC NULLS LAST, c.customer_key NULLS FIRST LIMIT 10"),
        "e24_top_customers_dirty_keys": customer_revenue(
            "dirty_fact_sales", "ORDER BY total_revenue DESC NULLS LAST, c.customer_key NULLS FIRST LIMIT 10"),
        "e25_fewest_orders": fewest_orders("fact_sales", 3),
        "e25_fewest_orders_dirty_keys": fewest_orders("dirty_fact_sales", 10),
        "e26_activity_by_year_month": activity(
            "CAST(year(order_date) AS INTEGER) AS order_year, CAST(month(order_date) AS INTEGER) AS order_month", "1, 2"),
        "e27_activity_by_month_start": activity("CAST(date_trunc('month', order_date) AS DATE) AS order_date", "1"),
        "e28_activity_by_month_text": activity("strftime(order_date, '%Y-%b') AS order_date", "1"),
        "e29_running_totals": running("year"),
        "e29_running_totals_monthly": running("month"),
        "e29_running_totals_exact": running("year", exact=True),
        "e30_product_performance": performance("fact_sales"),
        "e30_product_performance_dirty_keys": performance("dirty_fact_sales"),
        "e31_products_by_cost_band": on_star(
            "SELECT CASE WHEN cost < 100 THEN 'Below 100' WHEN cost BETWEEN 100 AND 500 THEN '100-500' "
            "WHEN cost BETWEEN 500 AND 1000 THEN '500-1000' ELSE 'Above 1000' END AS cost_range, "
            "count(product_key) AS total_products FROM dim_products GROUP BY 1"),
        "e32_customers_by_segment": customers_by_segment(5000),
        "e32_customers_by_segment_high_spend": customers_by_segment(star.HIGH_SPEND),
        "e33_category_shares": on_star(
            "SELECT category, total_sales, CAST(sum(total_sales) OVER () AS BIGINT) AS overall_sales, "
            "round(CAST(total_sales AS DOUBLE) / CAST(sum(total_sales) OVER () AS DOUBLE) * 100, 2) "
            f"AS percentage_of_total FROM (SELECT category, {total('sales_amount')} AS total_sales "
            f"FROM {revenue_by_category} GROUP BY category)"),
        "e34_report_customers": on_star(customer_report("fact_sales", 5000)),
        "e34_report_customers_high_spend": on_star(report),
        "e34_report_customers_as_written": on_star(
            "SELECT * EXCLUDE (total_products) REPLACE (total_products AS lifespan) "
            f"FROM ({customer_report('fact_sales', 5000)})"),
        "e34_report_customers_dirty_keys": on_star(customer_report("dirty_fact_sales", 5000)),
        "e35_report_products": on_star(products),
        "e35_report_products_dirty_keys": on_star(product_report("dirty_fact_sales")),
        "a02_read_gold_csv": on_star("SELECT * FROM dim_customers"),
        "a03_load_fact": on_star("SELECT * FROM fact_sales"),
        "a04_load_customers": on_star("SELECT * FROM dim_customers"),
        "a05_load_products": on_star("SELECT * FROM dim_products"),
        "a06_load_report_customers": on_star(report),
        "a07_load_report_products": on_star(products),
        "a08_save_gold_tables": on_star(" UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS left_rows, count(*) AS right_rows, true AS matches FROM {t}"
            for t in ("dim_customers", "dim_products", "fact_sales"))),
        "a10_publish_report_view": on_star(products),
        "a10_publish_report_table": on_star(report),
        "a10_persistent_view_customers": on_star(report),
        "a10_persistent_view_products": on_star(products),
        "m07_filters_stored_date_slice": on_star(
            "SELECT * FROM fact_sales WHERE order_date BETWEEN DATE '1996-03-10' AND DATE '1996-09-20'"),
        "q01_measures_observed_while_written": on_star(" UNION ALL ".join([
            "SELECT 'fact_sales' AS table_name, 'rows' AS measure, CAST(NULL AS VARCHAR) AS column_name, "
            "count(*) AS value FROM dirty_fact_sales",
            "SELECT 'fact_sales', 'sum', 'sales_amount', CAST(sum(sales_amount) AS BIGINT) FROM dirty_fact_sales",
            *[f"SELECT 'fact_sales', 'nulls', '{c}', count(*) - count({c}) FROM dirty_fact_sales" for c in (
                "order_number", "product_key", "customer_key", "order_date", "shipping_date", "due_date",
                "sales_amount", "quantity", "price")]])),
        "q01_null_counts": on_star(" UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls FROM dirty_fact_sales"
            for c in ("product_key", "customer_key", "order_date", "order_number"))),
        "q02_orphan_customers": on_star(
            "SELECT customer_key, count(*) AS lines FROM dirty_fact_sales f WHERE NOT EXISTS "
            "(SELECT 1 FROM dim_customers c WHERE c.customer_key = f.customer_key) GROUP BY 1"),
        "q02_orphan_products": on_star(
            "SELECT product_key, count(*) AS lines FROM dirty_fact_sales f WHERE NOT EXISTS "
            "(SELECT 1 FROM dim_products p WHERE p.product_key = f.product_key) GROUP BY 1"),
        "q05_row_count_match": on_star(" UNION ALL ".join(
            f"SELECT '{name}' AS table_name, (SELECT count(*) FROM {a}) AS left_rows, "
            f"(SELECT count(*) FROM {b}) AS right_rows, "
            f"(SELECT count(*) FROM {a}) = (SELECT count(*) FROM {b}) AS matches"
            for name, a, b in (("fact_sales", "fact_sales", "dirty_fact_sales"),
                               ("dim_products", "dim_products", "dim_products")))),
    }


# --- sales frame, KPIs, insights, charts, snapshot -----------------------------------------

def sales_frame(fact: str = "fact_sales", where: str = "true") -> list[str]:
    """Common table expressions up to ``sales``."""
    return [
        f"report AS ({customer_report(fact, star.HIGH_SPEND)})",
        f"""all_sales AS (
  SELECT f.*, product_name, category, subcategory, cost, country, gender, marital_status,
         customer_segment, age_group,
         CAST(date_trunc('month', order_date) AS DATE) AS order_month,
         CAST(year(order_date) AS INTEGER) AS order_year,
         sales_amount - cost * quantity AS profit,
         CASE WHEN f.customer_key IS NULL THEN false
              ELSE year(order_date) > min(year(order_date)) OVER (PARTITION BY f.customer_key) END AS is_returning
  FROM {fact} f {PRODUCT_JOIN} {CUSTOMER_JOIN} LEFT JOIN report r ON r.customer_key = f.customer_key
  WHERE order_date IS NOT NULL
)""",
        f"sales AS (SELECT * FROM all_sales WHERE {where})",
    ]


NOTHING = "order_date BETWEEN DATE '1900-01-01' AND DATE '1900-12-31'"


def on_sales(body: str, fact: str = "fact_sales", where: str = "true") -> str:
    return on_star(body, *sales_frame(fact, where))


def nsum(c: str, cast: str = "BIGINT") -> str:
    """A sum that is 0 when there is nothing to add."""
    return f"CAST(coalesce(sum({c}), 0) AS {cast})"


def pct(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) * 100"


def fixed(c: str, places: int) -> str:
    return f"format('{{:.{places}f}}', CAST({c} AS DOUBLE))"


def commas(c: str) -> str:
    return f"format('{{:,.0f}}', CAST({c} AS DOUBLE))"


KPIS = f"""
SELECT revenue, profit, CASE WHEN revenue <> 0 THEN profit / revenue * 100 ELSE 0 END AS margin,
       orders, customers, units, CASE WHEN orders > 0 THEN revenue / orders ELSE 0 END AS aov,
       CASE WHEN orders > 0 THEN CAST(units AS DOUBLE) / orders ELSE 0 END AS items_per_order
FROM (SELECT {nsum('sales_amount', 'DOUBLE')} AS revenue, {nsum('profit', 'DOUBLE')} AS profit,
             count(DISTINCT order_number) AS orders, count(DISTINCT customer_key) AS customers,
             {nsum('quantity')} AS units FROM sales)"""


def by(key: str, alias: str | None = None) -> str:
    """Revenue and profit per known key."""
    name = alias or key
    return (f"(SELECT {key} AS {name}, {nsum('sales_amount')} AS rev, {nsum('profit')} AS profit, "
            f"{nsum('CASE WHEN is_returning THEN sales_amount END')} AS returning_rev "
            f"FROM sales WHERE {key} IS NOT NULL GROUP BY 1)")


CONCENTRATION = f"""
SELECT category, {pct('rev', 'total')} AS share_pct
FROM (SELECT *, sum(rev) OVER () AS total FROM {by('category')}) WHERE total <> 0
ORDER BY rev DESC, category LIMIT 1"""

MARGIN = f"""
SELECT category, margin AS margin_pct, {pct('all_profit', 'total')} AS overall_margin_pct,
       {pct('rev', 'total')} AS share_pct
FROM (SELECT *, {pct('profit', 'rev')} AS margin, sum(rev) OVER () AS total, sum(profit) OVER () AS all_profit
      FROM {by('category')} WHERE rev > 0)
ORDER BY margin DESC, category LIMIT 1"""

REPEAT = f"""
SELECT {pct('(SELECT count(*) FROM repeaters)', 'customers')} AS repeat_customer_pct,
       {pct('repeat_rev', 'rev')} AS repeat_revenue_pct
FROM (SELECT count(DISTINCT customer_key) AS customers, {nsum('sales_amount')} AS rev,
             {nsum('CASE WHEN customer_key IN (SELECT customer_key FROM repeaters) THEN sales_amount END')}
             AS repeat_rev FROM sales)
WHERE customers > 0 AND rev <> 0"""
REPEATERS = ("repeaters AS (SELECT customer_key FROM sales WHERE customer_key IS NOT NULL GROUP BY 1 "
             "HAVING count(DISTINCT order_number) >= 2)")

GROWTH = f"""
SELECT order_year AS peak_year, rev AS peak_revenue, {pct('returning_rev', 'rev')} AS returning_share_pct
FROM (SELECT * FROM {by('order_year')} ORDER BY rev DESC, order_year LIMIT 1) WHERE rev <> 0"""

MARKETS = f"""
SELECT string_agg(country, ' + ' ORDER BY rev DESC, country) AS countries,
       {pct('sum(rev)', 'max(total)')} AS share_pct
FROM (SELECT *, sum(rev) OVER () AS total FROM {by('country')} ORDER BY rev DESC, country LIMIT 2)
HAVING max(total) <> 0"""

SEASONS = f"""
SELECT (SELECT month FROM by_month ORDER BY rev DESC, month LIMIT 1) AS strongest_month,
       (SELECT month FROM by_month ORDER BY rev, month LIMIT 1) AS weakest_month,
       CAST(max(rev) AS DOUBLE) / CAST(min(rev) AS DOUBLE) AS ratio
FROM by_month HAVING min(rev) <> 0"""
BY_MONTH = f"by_month AS (SELECT * FROM {by('CAST(month(order_date) AS INTEGER)', 'month')})"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def card(position: int, name: str, icon: str, title: str, metric: str, takeaway: str, action: str, source: str) -> str:
    return (f"SELECT {position} AS position, '{name}' AS id, '{icon}' AS icon, {quoted(title)} AS title, "
            f"{metric} AS metric, {takeaway} AS takeaway, {action} AS action FROM {source}")


def month_name(c: str) -> str:
    return f"strftime(make_date(2000, {c}, 1), '%B')"


def cards() -> str:
    share1 = fixed("share_pct", 1)
    return " UNION ALL ".join([
        card(1, "category_concentration", "🎯", "Revenue concentration", f"{share1} || '%'",
             f"'**' || category || '** alone accounts for **' || {share1} || '%** of revenue. "
             "The business is heavily reliant on a single category.'",
             quoted("Diversify the catalogue and grow the smaller categories to reduce risk."), "concentration"),
        card(2, "margin_opportunity", "💰", "Margin opportunity", f"{fixed('margin_pct', 0)} || '% margin'",
             f"'**' || category || '** earns the richest margin (**' || {fixed('margin_pct', 0)} || '%** vs ' || "
             f"{fixed('overall_margin_pct', 0)} || '% overall) but is only **' || {share1} || '%** of sales.'",
             "'Push ' || lower(category) || ' as add-on/attach items — they lift profit far more than their "
             "revenue share suggests.'", "margin"),
        card(3, "repeat_customer_value", "🔁", "Repeat customers carry the business",
             f"{fixed('repeat_revenue_pct', 0)} || '% of revenue'",
             f"'Just **' || {fixed('repeat_customer_pct', 0)} || '%** of customers buy more than once, yet they "
             f"generate **' || {fixed('repeat_revenue_pct', 0)} || '%** of revenue.'",
             quoted("Invest in retention (loyalty, re-order nudges) over pure acquisition — "
                    "a second purchase is where the money is."), "repeaters_value"),
        card(4, "returning_growth", "📈", "Growth came from returning buyers",
             f"'€' || {fixed('peak_revenue / 1e6', 1)} || 'M peak'",
             f"'Revenue peaked in **' || peak_year || '** (€' || {fixed('peak_revenue / 1e6', 1)} || 'M), and **' || "
             f"{fixed('returning_share_pct', 0)} || '%** of that came from *returning* customers — "
             "the repeat-purchase flywheel kicking in.'",
             quoted("Protect the flywheel: keep first-time buyers engaged so they return."), "growth"),
        card(5, "market_concentration", "🌍", "Two markets dominate", f"{fixed('share_pct', 0)} || '%'",
             f"'**' || countries || '** together make up **' || {fixed('share_pct', 0)} || '%** of revenue.'",
             quoted("Defend the core two markets while testing growth in the long tail (UK, Germany, France)."),
             "markets"),
        card(6, "seasonality", "📅", "Clear seasonal peak", f"{fixed('ratio', 1)} || '× swing'",
             f"'**' || {month_name('strongest_month')} || '** is the strongest month and **' || "
             f"{month_name('weakest_month')} || '** the weakest — a **' || {fixed('ratio', 1)} || '×** swing.'",
             f"'Build inventory and marketing toward ' || {month_name('strongest_month')} || '; run promotions to "
             f"lift the ' || {month_name('weakest_month')} || ' trough.'", "seasons"),
    ])


def insight_cards(where: str) -> str:
    return on_star(
        cards(), *sales_frame(where=where), REPEATERS, BY_MONTH, f"concentration AS ({CONCENTRATION})",
        f"margin AS ({MARGIN})", f"repeaters_value AS ({REPEAT})", f"growth AS ({GROWTH})",
        f"markets AS ({MARKETS})", f"seasons AS ({SEASONS})")


def revenue_by(key: str, alias: str | None = None, tail: str = "") -> str:
    return on_sales(f"SELECT {alias or key}, rev AS sales_amount FROM {by(key, alias)} {tail}")


def top(key: str, n: int) -> str:
    return revenue_by(key, tail=f"ORDER BY rev DESC, {key} LIMIT {n}")


def ranked(key: str, n: int, columns: str, order: str = "rev DESC, ") -> str:
    return (f"SELECT {columns}, CAST(row_number() OVER (ORDER BY {order}{key}) AS INTEGER) AS rank FROM {by(key)} "
            f"ORDER BY {order}{key} LIMIT {n}")


CATEGORY_MARGIN = f"CASE WHEN rev <> 0 THEN {pct('profit', 'rev')} ELSE 0 END"
SEGMENTS = f"""
SELECT customer_segment, revenue, customers,
       CAST(row_number() OVER (ORDER BY revenue DESC, customer_segment) AS INTEGER) AS rank
FROM (SELECT customer_segment, {nsum('sales_amount')} AS revenue, count(DISTINCT customer_key) AS customers
      FROM sales WHERE customer_segment IS NOT NULL GROUP BY 1)"""
MANY = 1_000_000

SNAPSHOT_PARTS = [
    f"kpi AS ({KPIS})",
    f"cat AS ({ranked('category', MANY, f'category, rev AS revenue, {CATEGORY_MARGIN} AS margin')})",
    f"seg AS ({SEGMENTS})",
    f"yr AS ({ranked('order_year', MANY, 'order_year, rev', '')})",
    f"ctry AS ({ranked('country', 5, 'country, rev')})",
    f"prod AS ({ranked('product_name', 5, 'product_name, rev')})",
    "line_count AS (SELECT count(*) AS n FROM sales)",
]


def long(section: str, rank: str, key: str, metric: str, value: str, source: str) -> str:
    return (f"SELECT '{section}' AS section, {rank} AS rank, CAST({key} AS VARCHAR) AS key, '{metric}' AS metric, "
            f"CAST({value} AS DOUBLE) AS value FROM {source}")


def snapshot(where: str) -> str:
    rows = [
        "SELECT 'no_data' AS section, 1 AS rank, 'No data in the current filter.' AS key, "
        "CAST(NULL AS VARCHAR) AS metric, CAST(NULL AS DOUBLE) AS value FROM line_count WHERE n = 0",
        *[long("kpi", "1", "NULL", m, m, "kpi, line_count WHERE n > 0")
          for m in ("revenue", "profit", "margin", "orders", "customers", "units", "aov")],
        long("category", "rank", "category", "revenue", "revenue", "cat"),
        long("category", "rank", "category", "margin", "margin", "cat"),
        long("segment", "rank", "customer_segment", "revenue", "revenue", "seg"),
        long("segment", "rank", "customer_segment", "customers", "customers", "seg"),
        long("year", "rank", "order_year", "revenue", "rev", "yr"),
        long("top_countries", "rank", "country", "revenue", "rev", "ctry"),
        long("top_products", "rank", "product_name", "revenue", "rev", "prod"),
    ]
    return on_star(" UNION ALL ".join(rows), *sales_frame(where=where), *SNAPSHOT_PARTS)


def joined(section: int, label: str, key: str, source: str) -> str:
    return (f"SELECT {section}, 0, '- {label}: ' || coalesce(string_agg({key} || ': ' || {commas('rev')}, ', ' "
            f"ORDER BY rank), '') FROM {source}")


def snapshot_lines(where: str) -> str:
    money = (f"'- Revenue: ' || {commas('revenue')} || '; Gross profit: ' || {commas('profit')} || ' (' || "
             f"{fixed('margin', 1)} || '% margin)'")
    counts = (f"'- Orders: ' || {commas('orders')} || '; Customers: ' || {commas('customers')} || '; Units: ' || "
              f"{commas('units')} || '; Avg order value: ' || {commas('aov')}")
    text = " UNION ALL ".join([
        "SELECT 0 AS section, 0 AS rank, 'DATA SNAPSHOT (current dashboard filter; all figures in EUR):' AS line",
        f"SELECT 0, 1, {money} FROM kpi",
        f"SELECT 0, 2, {counts} FROM kpi",
        "SELECT 1, 0, '- Revenue & margin by category:'",
        f"SELECT 1, rank, '    ' || category || ': ' || {commas('revenue')} || ' (' || {fixed('margin', 0)} "
        "|| '% margin)' FROM cat",
        "SELECT 2, 0, '- By customer segment (revenue / #customers):'",
        f"SELECT 2, rank, '    ' || customer_segment || ': ' || {commas('revenue')} || ' / ' || {commas('customers')} FROM seg",
        joined(3, "Revenue by year", "order_year", "yr"),
        joined(4, "Top countries", "country", "ctry"),
        joined(5, "Top products", "product_name", "prod"),
    ])
    return on_star(
        f"SELECT t.* FROM ({text}) t, line_count WHERE n > 0 "
        "UNION ALL SELECT 0, 0, 'No data in the current filter.' FROM line_count WHERE n = 0",
        *sales_frame(where=where), *SNAPSHOT_PARTS)


def dashboard() -> dict[str, str]:
    dirty = "dirty_fact_sales"
    columns = ("order_number, product_key, customer_key, order_date, shipping_date, due_date, sales_amount, quantity, "
               "price, product_name, category, subcategory, cost, country, gender, marital_status, customer_segment, "
               "age_group, order_month, order_year, profit, is_returning")
    returning = (f"SELECT order_year, is_returning, {total('sales_amount')} AS sales_amount, count(*) AS lines "
                 "FROM sales GROUP BY 1, 2")
    fields = " UNION ALL ".join(
        f"SELECT DISTINCT '{c}', {c} FROM sales WHERE {c} IS NOT NULL"
        for c in ("category", "country", "customer_segment"))
    calendar = (f"SELECT CAST(range AS INTEGER) AS month, strftime(make_date(2000, CAST(range AS INTEGER), 1), '%b') "
                "AS month_name, rev AS sales_amount FROM range(1, 13) LEFT JOIN "
                f"{by('CAST(month(order_date) AS INTEGER)', 'month')} m ON m.month = range")

    def bands(where: str) -> str:
        return on_sales(
            "SELECT cost_range, count(cost) AS products FROM (VALUES ('Below 100', -1, 100), ('100-500', 100, 500), "
            "('500-1000', 500, 1000), ('Above 1000', 1000, 9000000000)) b(cost_range, low, high) "
            "LEFT JOIN (SELECT DISTINCT product_key, cost FROM sales) ON cost > low AND cost <= high GROUP BY 1",
            where=where)

    return {
        "a09_export_slice_csv": on_sales(
            "SELECT order_number, order_date, category, country, sales_amount FROM sales", where=SLICE),
        "m01_sales_frame": on_sales(f"SELECT {columns} FROM sales"),
        "m01_sales_frame_dirty_keys": on_sales(f"SELECT {columns} FROM sales", dirty),
        "m01_sales_frame_saved_segments": on_sales(f"SELECT {columns} FROM sales"),
        "m02_dated_lines": on_sales("SELECT count(*) AS lines FROM sales"),
        "m03_periods": on_sales("SELECT order_month, order_year, count(*) AS lines FROM sales GROUP BY 1, 2"),
        "m04_line_profit": on_sales(
            f"SELECT product_key, {total('profit')} AS profit, count(profit) AS lines_with_profit FROM sales GROUP BY 1"),
        "m05_returning_flag": on_sales(returning),
        "m05_returning_flag_dirty_keys": on_sales(returning, dirty),
        "m01_sales_frame_co_located": on_sales(f"SELECT {columns} FROM sales"),
        "m05_returning_flag_co_located": on_sales(returning),
        "m05_returning_flag_co_located_dirty_keys": on_sales(returning, dirty),
        "m06_filter_options": on_sales(
            "SELECT 'min_date' AS field, CAST(min(order_date) AS VARCHAR) AS value FROM sales "
            f"UNION ALL SELECT 'max_date', CAST(max(order_date) AS VARCHAR) FROM sales UNION ALL {fields}"),
        "m07_filters": on_sales(f"SELECT {columns} FROM sales", where=SLICE),
        "m07_filters_half_open_range": on_sales(
            f"SELECT {total('sales_amount')} AS total_sales FROM sales",
            where="country IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_5', 'NATION_8')"),
        "m07_filters_no_match": on_sales(f"SELECT {columns} FROM sales", where=NOTHING),
        "f01_kpis": on_sales(KPIS),
        "f01_kpis_of_frame": on_sales(KPIS),
        "f01_kpis_slice": on_sales(KPIS, where=SLICE),
        "f01_kpis_slice_of_frame": on_sales(KPIS, where=SLICE),
        "f01_kpis_no_sales": on_sales(KPIS, where=NOTHING),
        "f01b_revenue_per_customer": on_sales(
            "SELECT CAST(sum(sales_amount) AS DOUBLE) / count(DISTINCT customer_key) AS revenue_per_customer FROM sales"),
        "f02_category_concentration": on_sales(CONCENTRATION),
        "f03_margin_opportunity": on_sales(MARGIN),
        "f04_repeat_customer_value": on_star(REPEAT, *sales_frame(), REPEATERS),
        "f04_repeat_customer_value_dirty_keys": on_star(REPEAT, *sales_frame(dirty), REPEATERS),
        "f05_returning_growth": on_sales(GROWTH),
        "f06_market_concentration": on_sales(MARKETS),
        "f07_seasonality": on_star(SEASONS, *sales_frame(), BY_MONTH),
        "f08_all_insights": insight_cards("true"),
        "f08_all_insights_slice": insight_cards(SLICE),
        "f08_all_insights_slice_of_frame": insight_cards(SLICE),
        "f08_all_insights_no_sales": insight_cards(NOTHING),
        "g01_monthly_trend": revenue_by("order_month"),
        "g02_yearly_revenue": revenue_by("order_year"),
        "g03_category_share": on_sales(
            "SELECT category, sales_amount, share, share < 0.10 AS is_small FROM "
            "(SELECT category, rev AS sales_amount, CAST(rev AS DOUBLE) / CAST(sum(rev) OVER () AS DOUBLE) AS share "
            f"FROM {by('category')})"),
        "g04_new_vs_returning": on_sales(
            "SELECT order_year, CASE WHEN is_returning THEN 'Returning' ELSE 'New' END AS buyer, "
            f"{nsum('sales_amount')} AS sales_amount FROM sales GROUP BY 1, 2"),
        "g05_revenue_by_calendar_month": on_sales(calendar),
        "g05_revenue_by_calendar_month_gaps": on_sales(
            calendar, where="order_date BETWEEN DATE '1997-03-01' AND DATE '1997-08-31'"),
        "g06_top_subcategories": top("subcategory", 8),
        "g07_margin_by_category": on_sales(
            f"SELECT category, rev AS revenue, profit, {pct('profit', 'rev')} AS margin "
            f"FROM {by('category')} WHERE rev > 0"),
        "g08_top_products": top("product_name", 10),
        "g09_cost_segmentation": bands("true"),
        "g09_cost_segmentation_no_sales": bands(NOTHING),
        "g10_segment_split": on_sales(f"SELECT customer_segment, revenue, customers FROM ({SEGMENTS})"),
        "g11_age_groups": revenue_by("age_group"),
        "g12_top_countries": top("country", 10),
        "h01_kpi_figures": on_sales(f"SELECT * EXCLUDE (items_per_order) FROM ({KPIS})"),
        "h01_kpi_figures_of_frame": on_sales(f"SELECT * EXCLUDE (items_per_order) FROM ({KPIS})"),
        "h02_category_figures": on_star("SELECT * FROM cat", *sales_frame(), SNAPSHOT_PARTS[1]),
        "h03_segment_figures": on_sales(SEGMENTS),
        "h04_top_countries": on_star(
            "SELECT country, rev AS sales_amount, rank FROM ctry", *sales_frame(), SNAPSHOT_PARTS[4]),
        "h05_snapshot": snapshot("true"),
        "h05_snapshot_slice": snapshot(SLICE),
        "h05_snapshot_slice_of_frame": snapshot(SLICE),
        "h05_snapshot_no_sales": snapshot(NOTHING),
        "h05_snapshot_lines": snapshot_lines(SLICE),
        "h05_snapshot_lines_no_sales": snapshot_lines(NOTHING),
        "q03_join_coverage": on_sales(" UNION ALL ".join(
            f"SELECT '{c}' AS column_name, CAST(count({c}) AS DOUBLE) / count(*) AS coverage FROM sales"
            for c in ("category", "country", "cost")), dirty),
        "q06_revenue_reconciliation": on_sales(
            "SELECT l AS left_revenue, r AS right_revenue, CAST(abs(l - r) AS DOUBLE) / CAST(r AS DOUBLE) "
            "AS relative_difference, CAST(abs(l - r) AS DOUBLE) / CAST(r AS DOUBLE) < 0.0001 AS within_tolerance "
            f"FROM (SELECT {total('sales_amount')} AS l FROM sales), "
            f"(SELECT {total('sales_amount')} AS r FROM fact_sales)"),
        "q07_kpi_sanity": on_sales(
            "SELECT revenue > 0 AS has_revenue, orders > 0 AS has_orders, customers > 0 AS has_customers, "
            "profit <= revenue AS profit_within_revenue, margin BETWEEN 0 AND 100 AS margin_in_range, "
            f"abs(aov - revenue / orders) < 0.000001 AS aov_is_revenue_per_order FROM ({KPIS})"),
    }


def statements() -> dict[str, str]:
    return {**warehouse(), **scripts(), **dashboard()}
