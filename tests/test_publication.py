"""Builds that switch at once, what their writes saw, views that outlive a session, bucketed frames."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fixtures import bronze as raw
from fixtures.star import dim_customers, dim_products, dirty_fact_sales, fact_sales
from tillroll.operators import gold, quality, ranking, reports
from tillroll.plans import co_located, sales_model, warehouse
from tillroll.sources import publication, sinks, views


def rows_of(table):
    return sorted(map(str, table.collect()))


def numbers(spark, n):
    return spark.range(n).select("id", F.when(F.col("id") % 3 != 0, F.col("id")).alias("known"))


def publish(spark, out, n, **more):
    build = publication.Build(spark, out)
    build.write("numbers", numbers(spark, n), sums=["known"], **more)
    return build


def test_a_build_is_seen_when_it_is_published(spark, tmp_path):
    out = str(tmp_path)
    with pytest.raises(LookupError, match="nothing published"):
        publication.current(spark, out)
    build = publish(spark, out, 10)
    with pytest.raises(LookupError):
        publication.current(spark, out)
    assert build.publish() == 1 and publication.current(spark, out)["numbers"].count() == 10
    second = publish(spark, out, 20)
    assert publication.current(spark, out)["numbers"].count() == 10      # beside the old one
    assert second.publish() == 2 and publication.current(spark, out)["numbers"].count() == 20
    assert publication.current(spark, out, version=1)["numbers"].count() == 10
    with pytest.raises(LookupError, match="no version 7"):
        publication.current(spark, out, version=7)
    seen = {(r.measure, r.column_name): r.value for r in publication.measured(spark, out, 1).collect()}
    assert seen == {("rows", None): 10, ("nulls", "id"): 0, ("nulls", "known"): 4, ("sum", "known"): 1 + 2 + 4 + 5 + 7 + 8}


def test_a_build_that_dies_or_fails_its_check_changes_nothing(spark, tmp_path):
    out = str(tmp_path)
    publish(spark, out, 10).publish()
    before = rows_of(publication.current(spark, out)["numbers"])

    build = publication.Build(spark, out)
    build.write("numbers", numbers(spark, 5))
    broken = spark.range(50_000).select(F.when(F.col("id") == 49_999, F.raise_error(F.lit("lost"))).otherwise("x").alias("t"))
    with pytest.raises(Exception, match="lost"):
        build.write("text", broken)                                       # killed midway: half a build lies there
    with pytest.raises(ValueError, match="too few"):
        publish(spark, out, 5).publish(lambda seen: "too few rows" if seen["numbers"].rows < 6 else None)
    tampered = publish(spark, out, 5)
    sinks.save_tables({"more": numbers(spark, 1)}, tampered.tables["numbers"][0])
    numbers(spark, 1).write.mode("append").parquet(tampered.tables["numbers"][0])
    with pytest.raises(ValueError, match="holds 6 rows, 5 were written"):
        tampered.publish()
    assert rows_of(publication.current(spark, out)["numbers"]) == before
    assert publish(spark, out, 7).publish() == 2


def test_empty_tables_and_odd_columns_are_published(spark, tmp_path):
    build = publication.Build(spark, str(tmp_path))
    table = spark.createDataFrame([], "`a.b` string, rows long, n long")
    build.write("empty", table, sums=["n"])
    build.publish()
    assert publication.current(spark, str(tmp_path))["empty"].schema == table.schema
    assert build.measures["empty"] == publication.Measures(0, {"a.b": 0, "rows": 0, "n": 0}, {"n": None})


def test_never_around_an_input(spark, tmp_path):
    with pytest.raises(ValueError, match="over an input"):
        publication.Build(spark, str(tmp_path / "in"), [str(tmp_path)]).write("t", numbers(spark, 1))


def test_a_warehouse_killed_midway_leaves_the_old_one(spark, sf_dir, tmp_path, monkeypatch):
    out, bronze = str(tmp_path), raw.bronze(spark, sf_dir)
    assert warehouse.publish_warehouse(bronze, out, entry.AS_OF, inputs=[sf_dir]) == 1
    before = {name: rows_of(t) for name, t in publication.current(spark, out).items()}
    with monkeypatch.context() as patch:
        patch.setattr(gold, "build_fact_sales", lambda *_: spark.range(9).select(F.raise_error(F.lit("lost")).cast("date").alias("order_date")))
        with pytest.raises(Exception, match="lost"):
            warehouse.publish_warehouse(bronze, out, entry.AS_OF)
    assert {name: rows_of(t) for name, t in publication.current(spark, out).items()} == before
    # the writes saw what the stand-alone checks find
    tables = publication.current(spark, out)
    seen = {(r.table_name, r.measure, r.column_name): r.value for r in publication.measured(spark, out).collect()}
    for name, table in tables.items():
        assert seen[name, "rows", None] == table.count()
        assert {c: seen[name, "nulls", c] for c in table.columns} == {
            r.column_name: r.nulls for r in quality.null_counts(table, table.columns).collect()}
    assert seen["fact_sales", "sum", "sales_amount"] == tables["fact_sales"].agg(F.sum("sales_amount")).first()[0]
    # a fact without any known customer is not published
    strangers = bronze | {"crm_sales_details": bronze["crm_sales_details"].withColumn("sls_cust_id", F.lit("999999999"))}
    with pytest.raises(ValueError, match="no sales line knows its customer_key"):
        warehouse.publish_warehouse(strangers, out, entry.AS_OF)


def leaf_metrics(df, spark):
    """Files and row groups a query of one scan read."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df.collect()
        metrics = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics()
        return metrics.apply("numFiles").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_date_slice_reads_the_files_of_its_years(spark, sf_dir):
    fact = publication.current(spark, entry.published_star(spark, sf_dir))["fact_sales"]
    everything = leaf_metrics(fact, spark)
    sliced = sales_model.date_slice(fact, dt.date(1996, 3, 10), dt.date(1996, 9, 20))
    assert leaf_metrics(sliced, spark) <= 3 < everything
    assert sliced.count() == fact.where("order_date between '1996-03-10' and '1996-09-20'").count() > 0
    # files of a year have ranges of their own
    spans = fact.groupBy(F.input_file_name().alias("f")).agg(
        F.min("order_date").alias("a"), F.max("order_date").alias("b"), F.first("order_year").alias("y")).where("y is not null").collect()
    spans.sort(key=lambda r: (r.a, r.b))
    assert all(one.b <= two.a for one, two in zip(spans, spans[1:]))


def test_views_are_seen_from_another_session_and_hold_no_rows(spark, sf_dir, tmp_path):
    star = {"dim_customers": dim_customers(spark, sf_dir), "dim_products": dim_products(spark, sf_dir),
            "fact_sales": fact_sales(spark, sf_dir)}
    paths = sinks.save_tables(star, str(tmp_path / "one"))
    for _ in range(2):  # created anew
        views.publish_report_views(spark, paths, "v_customers", "v_products", entry.AS_OF)
    other = spark.newSession()
    assert rows_of(other.table("v_customers")) == rows_of(reports.report_customers(
        star["fact_sales"], star["dim_customers"], entry.AS_OF, keys_verified=True))
    assert rows_of(other.table("v_products")) == rows_of(reports.report_products(
        star["fact_sales"], star["dim_products"], entry.AS_OF, keys_verified=True))
    kinds = {t.name: t.tableType for t in other.catalog.listTables() if t.name.startswith("v_")}
    assert kinds == {"v_customers": "VIEW", "v_products": "VIEW"}
    # the schemas are those of the stored reports, and without a day given it is the day of reading
    assert other.table("v_customers").dtypes == reports.report_customers(star["fact_sales"], star["dim_customers"]).dtypes
    views.publish_report_views(spark, paths, "v_customers", "v_products")
    recency = other.table("v_customers").select("recency", "last_order_date").first()
    today = dt.date.today()
    assert recency[0] in range((today.year - recency[1].year) * 12 + today.month - recency[1].month - 1, 1 << 20)
    # rows that come later show at once
    more = spark.read.schema(star["fact_sales"].schema).parquet(paths["fact_sales"]).limit(1).withColumn(
        "customer_key", F.lit(1).cast("long")).withColumn("product_key", F.lit(987654321).cast("long")).collect()
    spark.createDataFrame(more, star["fact_sales"].schema).write.mode("append").parquet(paths["fact_sales"])
    spark.sql("REFRESH TABLE v_products")
    assert spark.table("v_products").where("product_key = 987654321").count() == 1
    for name in kinds:
        spark.sql(f"DROP VIEW {name}")


def test_a_clustered_table_is_built_once(spark, tmp_path):
    built = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            built.add(batch.num_rows)
            yield batch

    rows = spark.range(3_000, numPartitions=3).mapInArrow(count, "id long")
    build = publication.Build(spark, str(tmp_path))
    stored = build.write("t", rows, sums=["id"], cluster_by=["id"])
    assert stored.count() == 3_000 and build.measures["t"].rows == 3_000
    assert built.value == 3_000  # not once more for the ranges
    assert not spark._jsparkSession.sharedState().cacheManager().lookupCachedData(rows._jdf).isDefined()


# --- bucketed frames -----------------------------------------------------------------------

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot_lines", [1, 60, 10**9])
def test_the_bucketed_frame_is_the_frame(spark, sf_dir, tmp_path, hot_lines):
    fact, customers, products = dirty_fact_sales(spark, sf_dir), dim_customers(spark, sf_dir), dim_products(spark, sf_dir)
    name = f"bucketed_{hot_lines}"
    co_located.store_by_customer(fact, customers, name, str(tmp_path), buckets=4, hot_lines=hot_lines)
    cold, hot = spark.table(f"{name}_cold"), spark.table(f"{name}_hot")
    assert cold.count() + hot.count() == fact.count() and cold.where("customer_key is null").count() == 0
    assert (cold.groupBy("customer_key").count().agg(F.max("count")).first()[0] or 0) <= hot_lines
    mine = co_located.build_co_located(spark, name, products, entry.AS_OF, segment_spend=entry.HIGH_SPEND)
    theirs = sales_model.build_sales(fact, products, customers, as_of=entry.AS_OF, segment_spend=entry.HIGH_SPEND)
    assert rows_of(mine) == rows_of(theirs)
    for part in ("cold", "hot", "customers"):
        spark.sql(f"DROP TABLE {name}_{part}")


def test_buckets_follow_the_lines(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(co_located, "BUCKET_LINES", 100)
    fact = fact_sales(spark, sf_dir)
    co_located.store_by_customer(fact, dim_customers(spark, sf_dir), "many_buckets", str(tmp_path), buckets=4, hot_lines=60)
    lines = spark.table("many_buckets_cold").count()
    kept = {r.col_name: r.data_type for r in spark.sql("DESCRIBE EXTENDED many_buckets_cold").collect()}
    assert int(kept["Num Buckets"]) == -(-lines // 100) > 4
    for part in ("cold", "hot", "customers"):
        spark.sql(f"DROP TABLE many_buckets_{part}")


def test_bucketed_lines_meet_their_customers_without_an_exchange(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact, customers = fact_sales(spark, sf_dir), dim_customers(spark, sf_dir)
        co_located.store_by_customer(fact, customers, "bucketed_plan", str(tmp_path), buckets=4)
        cold = sales_model.build_sales(
            spark.table("bucketed_plan_cold"), dim_products(spark, sf_dir), spark.table("bucketed_plan_customers"),
            as_of=entry.AS_OF, co_located=True, columns=("order_year", "is_returning", "sales_amount", "customer_segment"))
        text = plan(cold)
        assert "SortMergeJoin" in text and "Exchange" not in text
        # with product labels, the only exchanges are the product lookup's, above the customer join
        whole = plan(sales_model.build_sales(
            spark.table("bucketed_plan_cold"), dim_products(spark, sf_dir), spark.table("bucketed_plan_customers"),
            as_of=entry.AS_OF, co_located=True))
        assert len(re.findall("Exchange hashpartitioning", whole)) == 2
        assert len(re.findall(r"Exchange hashpartitioning\(p(roduct_key|_partkey)#", whole)) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for part in ("cold", "hot", "customers"):
            spark.sql(f"DROP TABLE IF EXISTS bucketed_plan_{part}")


# --- dirty keys ----------------------------------------------------------------------------

def test_dirty_keys_are_looked_up_after_lines_are_reduced(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact, customers, products = dirty_fact_sales(spark, sf_dir), dim_customers(spark, sf_dir), dim_products(spark, sf_dir)
        for report in (reports.report_customers(fact, customers, entry.AS_OF),
                       reports.report_products(fact, products, entry.AS_OF), ranking.fewest_orders(fact, customers)):
            lines = plan(report).splitlines()
            for i, line in enumerate(lines):
                if "_known_key" in line and "Join" in line:
                    assert any("HashAggregate" in below for below in lines[i + 1:i + 6]), line
            assert "_known_key" in "\n".join(lines)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_orders_of_several_unknown_keys_count_once(spark):
    fact = spark.createDataFrame(
        [("A", 7, 1), ("A", 8, 2), ("B", 7, None), ("A", 1, None), ("C", 1, 3), (None, 9, 3), ("D", None, 3)],
        "order_number string, customer_key long, product_key long").select(
        "*", F.lit(dt.date(2013, 1, 1)).alias("order_date"), F.lit(10).cast("long").alias("sales_amount"),
        F.lit(1).cast("long").alias("quantity"))
    customers = spark.createDataFrame(
        [(1, "c1", "Ann", "Lee", dt.date(1990, 1, 1))], "customer_key long, customer_number string, first_name string, "
        "last_name string, birthdate date")
    got = {r.customer_key: (r.total_orders, r.total_sales, r.total_products)
           for r in reports.report_customers(fact, customers, entry.AS_OF).collect()}
    assert got == {1: (2, 20, 1), None: (3, 50, 3)}  # A, B, D and products 1, 2, 3
    fewest = {r.customer_key: r.total_orders for r in ranking.fewest_orders(fact, customers, n=5).collect()}
    assert fewest == {1: 2, None: 3}
