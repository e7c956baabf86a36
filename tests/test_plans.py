"""The physical plans hold what the operators promise about scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fixtures.star import dim_customers, dim_products, fact_sales
from tillroll.operators import explore, gold, insights, ranking, reports, snapshot, totals, trend
from tillroll.plans import star_parts
from tillroll.plans.sales_model import build_sales


@pytest.fixture
def without_broadcast(spark):
    """Plans as they are for tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


OWN = sorted(set(entry.queries()) - set(entry.llm.queries() if entry.llm else ()))
SPLIT_EARLY = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture
def early_split(without_broadcast):
    """Adaptive execution that takes small partitions for skewed ones."""
    spark = without_broadcast
    previous = {k: spark.conf.get(k, None) for k in SPLIT_EARLY}
    for k, v in SPLIT_EARLY.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in previous.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def test_only_needed_columns_are_read(spark, sf_dir):
    revenue = explore.revenue_by_category(
        fact_sales(spark, sf_dir, "product_key", "sales_amount"), dim_products(spark, sf_dir))
    reads = re.findall(r"ReadSchema: struct<([^>]*)>", plan(revenue))
    assert sorted(reads) == ["l_partkey:bigint,l_extendedprice:double", "p_partkey:bigint,p_type:string"]


def test_filters_reach_the_scan(spark, sf_dir, tmp_path):
    fact_sales(spark, sf_dir).write.parquet(str(tmp_path / "fact"))
    fact = spark.read.parquet(str(tmp_path / "fact"))
    report = reports.report_products(fact, dim_products(spark, sf_dir), entry.AS_OF)
    assert "PushedFilters: [IsNotNull(order_date)]" in plan(report)


def test_lines_are_summed_before_they_meet_a_dimension(without_broadcast, sf_dir):
    revenue = explore.revenue_by_customer(
        fact_sales(without_broadcast, sf_dir, "customer_key", "sales_amount"),
        dim_customers(without_broadcast, sf_dir))
    text = plan(revenue)
    lines = text.splitlines()
    join = next(i for i, line in enumerate(lines) if "_known_key" in line and "Join" in line)
    below = lines[join + 1:]
    assert any("HashAggregate" in line and "sum(sales_amount" in line for line in below)


@pytest.mark.parametrize("name", OWN)
def test_no_window_takes_unreduced_rows_into_one_task(spark, sf_dir, name):
    check_single_tasks(entry.queries()[name](spark, sf_dir))


@pytest.mark.parametrize("report", [insights.all_insights, snapshot.snapshot, snapshot.snapshot_lines])
def test_no_report_takes_unreduced_rows_into_one_task(spark, sf_dir, report):
    """The same for the reports of many parts, whose queries store the parts first."""
    check_single_tasks(report(entry.sales_frame(spark, sf_dir)))


def check_single_tasks(df):
    lines = plan(df).splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            # one task only ever receives aggregates: partial states, groups or per-task top rows
            below = "\n".join(lines[i + 1:i + 4])
            assert re.search(r"Aggregate|TakeOrdered|LocalLimit|WindowGroupLimit", below), line + "\n" + below


def test_ranking_is_cut_in_each_task_first(spark, sf_dir):
    ranked = ranking.ranked_products(
        fact_sales(spark, sf_dir, "product_key", "sales_amount"), dim_products(spark, sf_dir))
    lines = plan(ranked).splitlines()
    single = next(i for i, line in enumerate(lines) if "SinglePartition" in line)
    assert any("WindowGroupLimit" in line and "Partial" in line for line in lines[single:])


def test_top_lists_need_no_full_sort(spark, sf_dir):
    top = ranking.top_customers(
        fact_sales(spark, sf_dir, "customer_key", "sales_amount"), dim_customers(spark, sf_dir))
    assert "TakeOrderedAndProject" in plan(top)


def test_shares_need_no_common_task(spark, sf_dir):
    shares = trend.category_shares(
        fact_sales(spark, sf_dir, "product_key", "sales_amount"), dim_products(spark, sf_dir))
    assert "Window" not in plan(shares) and "CartesianProduct" not in plan(shares)


def test_two_distinct_counts_do_not_expand_the_lines(spark, sf_dir):
    report = reports.report_customers(
        fact_sales(spark, sf_dir), dim_customers(spark, sf_dir), entry.AS_OF, keys_verified=True)
    assert "Expand" not in plan(report)


def test_what_the_frame_broadcasts_is_bounded(without_broadcast, sf_dir):
    """With dimensions too large to broadcast, nothing is."""
    sales = build_sales(
        fact_sales(without_broadcast, sf_dir), dim_products(without_broadcast, sf_dir),
        dim_customers(without_broadcast, sf_dir), as_of=entry.AS_OF)
    text = plan(sales).split("Subqueries")[0]
    assert "BroadcastHashJoin" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def splits(df):
    """Whether each sort-merge join of the final plan split a skewed partition."""
    return ["skew=true" in line for line in final_plan(df).splitlines() if "SortMergeJoin" in line]


def test_a_hot_key_in_a_dimension_lookup_is_split(early_split):
    """Both lookups of the fact build shuffle straight into the join, so AQE can split them."""
    row = early_split.range(0, 40_000, 1, 16)
    text = F.col("id").cast("string")
    hot = F.col("id") % 3 == 0
    lines = row.select(
        text.alias("sls_ord_num"), F.when(hot, "7").otherwise(text).alias("sls_prd_key"),
        F.when(hot, "8").otherwise(text).alias("sls_cust_id"),
        F.lit(None).cast("date").alias("sls_order_dt"), F.lit(None).cast("date").alias("sls_ship_dt"),
        F.lit(None).cast("date").alias("sls_due_dt"), F.col("id").alias("sls_sales"),
        F.col("id").alias("sls_quantity"), F.col("id").alias("sls_price"))
    products = row.select(F.col("id").alias("product_key"), text.alias("product_number"))
    customers = row.select(F.col("id").alias("customer_key"), F.col("id").alias("customer_id"))
    fact = gold.build_fact_sales({"crm_sales_details": lines}, products, customers)
    assert splits(fact) == [True, True]
    assert fact.where("product_key is null or customer_key is null").count() == 0


def hot_star(spark, missing):
    """A star in which a third of all lines are of one product and one customer (or none)."""
    row = spark.range(0, 60_000, 1, 16)
    hot = F.col("id") % 3 == 0
    fact = row.select(
        F.xxhash64("id").cast("string").alias("order_number"),
        F.when(hot, 7).otherwise(F.col("id")).alias("product_key"),
        F.when(hot, None if missing else 8).otherwise(F.col("id")).alias("customer_key"),
        F.lit("2013-01-01").cast("date").alias("order_date"), F.lit(None).cast("date").alias("shipping_date"),
        F.lit(None).cast("date").alias("due_date"),
        F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("sales_amount"),
        F.lit(1).cast("long").alias("quantity"), F.lit(1).cast("long").alias("price"))
    products = row.select(F.col("id").alias("product_key"), *[
        F.lit("x").alias(c) for c in ("product_name", "category", "subcategory")], F.lit(1).cast("long").alias("cost"))
    customers = row.select(F.col("id").alias("customer_key"), *[
        F.lit("x").alias(c) for c in ("country", "gender", "marital_status")],
        F.lit("1990-01-01").cast("date").alias("birthdate"))
    return fact, products, customers


@pytest.mark.parametrize("missing", [False, True])
def test_a_hot_customer_and_product_of_the_sales_frame_are_split(early_split, missing):
    sales = build_sales(*hot_star(early_split, missing), as_of=entry.AS_OF)
    # the product lookup and the lines' lookup of the profile; the profile's own join has a row per customer
    assert splits(sales).count(True) == 2
    assert sales.count() == 60_000
    assert sales.where("country is null").count() == (20_000 if missing else 0)


def test_hot_keys_are_split_when_dangling_ones_are_resolved(early_split):
    fact, products, _ = hot_star(early_split, False)
    resolved = totals.resolve_keys(fact.select("product_key", "sales_amount"), products, "product_key")
    assert splits(resolved) == [True]


def test_kpis_do_not_expand_the_lines(spark, sf_dir):
    for name in ("f01_kpis", "h01_kpi_figures", "q07_kpi_sanity"):
        assert "Expand" not in plan(entry.queries()[name](spark, sf_dir))


def test_filter_options_take_one_aggregation_of_the_lines(without_broadcast, sf_dir):
    text = plan(entry.queries()["m06_filter_options"](without_broadcast, sf_dir))
    assert "Expand" not in text
    assert len(re.findall(r"ReadSchema: struct<[^>]*l_partkey", text)) <= 1


def exchanges(df):
    return [line for line in plan(df).splitlines() if "Exchange hashpartitioning" in line]


@pytest.mark.parametrize("name", ["f01_kpis", "f04_repeat_customer_value", "h01_kpi_figures", "h03_segment_figures",
                                  "e12_ordering_customers", "e13_key_metrics", "g10_segment_split", "f01b_revenue_per_customer"])
def test_distinct_counts_shuffle_bitmaps_not_keys(without_broadcast, sf_dir, name):
    df = entry.queries()[name](without_broadcast, sf_dir)
    assert not any("order_number" in line for line in exchanges(df))
    assert not re.search(r"Expand|count\(distinct (order_number|customer_key)", plan(df))


def test_the_product_part_sums_lines_before_its_lookup_and_knows_no_customer(without_broadcast, sf_dir):
    spark = without_broadcast
    fact = fact_sales(spark, sf_dir, *star_parts.LINE_COLUMNS)
    lines = star_parts.star_lines(fact, dim_products(spark, sf_dir), None)
    text = plan(star_parts.product_part(lines, dim_products(spark, sf_dir)))
    assert "c_custkey" not in text
    assert "HashAggregate(keys=[product_key" in text[:text.index("l_orderkey")]
    # unfiltered lines meet no lookup at all
    assert not re.search("p_partkey|c_custkey", plan(lines))


def test_a_filter_looks_lines_up_once_on_each_side_it_names(without_broadcast, sf_dir):
    spark = without_broadcast
    fact, products = fact_sales(spark, sf_dir, *star_parts.LINE_COLUMNS), dim_products(spark, sf_dir)
    profile = spark.createDataFrame([], "customer_key long, country string, customer_segment string, _first_year int")
    found = star_parts.star_lines(fact, products, profile, **entry.SLICE)
    assert len(re.findall(r"Join \[[^\]]*\], \[[^\]]*\], LeftSemi", plan(found))) == 2
    assert len(re.findall(r"ReadSchema: struct<[^>]*l_partkey", plan(found))) == 1


@pytest.mark.parametrize("name", ["c01_dim_customers", "c05_dim_products"])
def test_lookup_keys_are_proved_unique_on_the_key_column_alone(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "_copies" in text and not re.search(r"min\(struct\([^)]*(bdate|cntry|maintenance)", text)
