import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tillroll import schemas
from tillroll.operators import gold, quality
from tillroll.operators.keys import dense_keys
from tillroll.plans import warehouse

AS_OF = dt.date(2025, 1, 31)


@pytest.fixture
def bronze(spark):
    data = {
        "crm_cust_info": [
            ("12", "AW12", "Jon", "Yang", "M", "M", "2025-10-06"),
            ("11", "AW11", "Amy", "Lee", "S", "", "2025-10-06"),
            ("13", "AW13", "Bo", "X", "", "", "2025-10-06")],
        "crm_prd_info": [
            ("2", "AC-BR-P1", "Rack", "10", "S", "2011-07-01", "2007-12-28"),
            ("3", "AC-BR-P1", "Rack new", "12", "S", "2013-07-01", ""),
            ("1", "CO-PE-P2", "Pedal", "5", "M", "2013-07-01", ""),
            ("4", "AC-BR-P3", "Undated", "7", "T", "", ""),
            ("5", "AC-BR-P3", "Dated", "8", "T", "2013-07-01", "")],
        "crm_sales_details": [
            ("S1", "P1", "12", "20130316", "20130323", "20130328", "24", "2", "12"),
            ("S1", "P2", "11.0", "20130316", "20130323", "20130328", "5", "1", "5"),
            ("S2", "P9", "99", "0", "20130323", "20130328", "5", "1", "5"),
            ("S3", "P3", "", "20130401", "20130423", "20130428", "7", "1", "7")],
        "erp_cust_az12": [("NASAW11", "1971-10-06", "F"), ("AW12", "2999-01-01", "F")],
        "erp_loc_a101": [("AW-11", "DE"), ("AW-12", "")],
        "erp_px_cat_g1v2": [("AC_BR", "Accessories", "Bike Racks", "Yes")],
    }
    return {n: spark.createDataFrame(rows, schemas.BRONZE[n]) for n, rows in data.items()}


def test_customers(bronze):
    got = warehouse.build_warehouse(bronze, AS_OF)["dim_customers"].orderBy("customer_key").collect()
    assert [(r.customer_key, r.customer_id) for r in got] == [(1, 11), (2, 12), (3, 13)]
    assert [r.gender for r in got] == ["Female", "Male", "n/a"]     # ERP only fills an unknown CRM label
    assert [r.country for r in got] == ["Germany", "n/a", "n/a"]
    assert [r.birthdate for r in got] == [dt.date(1971, 10, 6), None, None]


def test_products(bronze):
    got = warehouse.build_warehouse(bronze, AS_OF)["dim_products"].orderBy("product_key").collect()
    assert [(r.product_key, r.product_id, r.product_number) for r in got] == [(1, 1, "P2"), (2, 3, "P1"), (3, 4, "P3")]
    assert [r.category for r in got] == [None, "Accessories", "Accessories"]
    assert got[2].product_name == "Undated"     # an unknown start date counts as the latest


def test_fact(bronze):
    fact = warehouse.build_warehouse(bronze, AS_OF)["fact_sales"]
    assert fact.schema == schemas.FACT_SALES
    got = {(r.order_number, r.product_key, r.customer_key, r.order_date) for r in fact.collect()}
    assert got == {
        ("S1", 2, 2, dt.date(2013, 3, 16)), ("S1", 1, 1, dt.date(2013, 3, 16)),
        ("S2", None, None, None), ("S3", 3, None, dt.date(2013, 4, 1))}


def test_gold_schemas(bronze):
    tables = warehouse.build_warehouse(bronze, AS_OF)
    for name, schema in (("dim_customers", schemas.DIM_CUSTOMERS), ("dim_products", schemas.DIM_PRODUCTS)):
        assert [(f.name, f.dataType) for f in tables[name].schema] == [(f.name, f.dataType) for f in schema]


def test_rebuilt_tables_pass_the_checks(bronze):
    tables = warehouse.build_warehouse(bronze, AS_OF)
    assert quality.duplicate_keys(tables["dim_customers"], "customer_id").count() == 0
    assert quality.duplicate_keys(tables["dim_products"], "product_number").count() == 0


def dense(spark, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "id long").repartition(7)
    return [(r.k, r.id) for r in dense_keys(rows, "id", "k").collect()]


def test_dense_keys_equal_a_global_numbering(spark):
    rng = random.Random(7)
    ids = list({rng.randrange(-2**62, 2**62) for _ in range(300)} | set(range(65_500, 65_600))
               | {2**40 - 1, 2**40, -1, 0, 2**63 - 1, -2**63})
    assert sorted(dense(spark, ids)) == [(n, i) for n, i in enumerate(sorted(ids), 1)]


def test_dense_keys_number_leaves_in_parallel(spark):
    rows = spark.range(200_000).withColumnRenamed("id", "n")
    keyed = dense_keys(rows, "n", "k")
    assert keyed.where(F.col("k") != F.col("n") + 1).count() == 0
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    row_number = next(line for line in plan.splitlines() if "row_number" in line)
    assert "_g1" in row_number          # rows are never numbered in one task


def windows(df):
    """(partition, order) of every window in the plan."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in text.splitlines() if line.lstrip(" :+-").startswith("Window")]


def test_dense_keys_bound_every_window(spark):
    """Sparse ids below 2^40: a leaf each, and no window takes them all."""
    rows = spark.range(100_000).select((F.col("id") * 9_000_011).alias("n"))
    keyed = dense_keys(rows, "n", "k")
    assert keyed.where(F.col("k") != F.col("n") / 9_000_011 + 1).count() == 0
    assert all("windowspecdefinition(_g" in w for w in windows(keyed) if "row_number" in w)


@pytest.mark.parametrize("extract, row", [
    ("erp_cust_az12", ("AW11", "1971-10-06", "F")), ("erp_loc_a101", ("AW11", "FR")),
    ("erp_px_cat_g1v2", ("AC_BR", "Accessories", "Bike Racks", "No"))])
def test_a_key_listed_twice_fails_the_build(spark, bronze, extract, row):
    twice = bronze | {extract: bronze[extract].unionByName(spark.createDataFrame([row], schemas.BRONZE[extract]))}
    tables = warehouse.build_warehouse(twice, AS_OF)
    with pytest.raises(Exception, match="holds a key twice"):
        tables["dim_products" if extract == "erp_px_cat_g1v2" else "dim_customers"].collect()
    # the fact needs no attributes, and cannot be doubled by them
    assert tables["fact_sales"].agg(F.sum("sales_amount")).first()[0] == 24 + 5 + 5 + 7


def test_sources_are_joined_once(spark, bronze):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = warehouse.build_warehouse(bronze, AS_OF)
        for name, column in (("dim_customers", "_erp_key"), ("dim_products", "category_id")):
            text = tables[name]._jdf.queryExecution().optimizedPlan().toString()
            joins = [line for line in text.splitlines() if "Join LeftOuter" in line]
            assert len(joins) == (2 if name == "dim_customers" else 1), text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_fractional_quantity_counts_in_full(spark, bronze):
    line = ("S9", "P1", "12", "20130316", "20130323", "20130328", "15", "1.5", "10")
    extended = bronze | {"crm_sales_details": bronze["crm_sales_details"].unionByName(
        spark.createDataFrame([line], schemas.BRONZE["crm_sales_details"]))}
    row = warehouse.build_warehouse(extended, AS_OF)["fact_sales"].where("order_number = 'S9'").first()
    assert (row.sales_amount, row.quantity, row.price) == (15, 2, 10)


def test_stored_fact_by_year_prunes(spark, bronze, tmp_path):
    tables = warehouse.write_warehouse(bronze, str(tmp_path / "gold"), AS_OF, by_year=True)
    slice_ = tables["fact_sales"].where("order_year = 2013")
    assert slice_.count() == 3 and tables["fact_sales"].count() == 4
    assert "PartitionFilters: [isnotnull(order_year" in slice_._jdf.queryExecution().executedPlan().toString()


def test_gender_preference(spark):
    rows = spark.createDataFrame([("Male", "Female"), ("n/a", "Female"), ("n/a", None)], "crm string, erp string")
    got = [r[0] for r in rows.select(gold.preferred_gender(F.col("crm"), F.col("erp"))).collect()]
    assert got == ["Male", "Female", "n/a"]


def test_a_session_without_settings_keeps_its_methods_compiled(spark, bronze):
    name = "spark.sql.codegen.hugeMethodLimit"
    kept = spark.conf.get(name)
    try:
        spark.conf.set(name, "65535")
        warehouse.build_silver(bronze)
        assert int(spark.conf.get(name)) <= 8000
        spark.conf.set(name, "4000")  # stricter than needed stays
        warehouse.build_silver(bronze)
        assert spark.conf.get(name) == "4000"
    finally:
        spark.conf.set(name, kept)
