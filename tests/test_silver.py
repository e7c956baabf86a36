import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillroll import schemas
from tillroll.operators import silver


def bronze(spark, name, *rows):
    return spark.createDataFrame(list(rows), schemas.BRONZE[name])


def customer(id_, first="A", marital="M", gender="M", date="2025-01-01"):
    return (id_, f"AW{id_}", first, "X", marital, gender, date)


def test_trim_and_decode(spark):
    rows = bronze(spark, "crm_cust_info", customer("1", " Jon"), customer("2", "Amy ", "s", "F"),
                  customer("3", "\tBo\xa0", "", ""))
    got = silver.clean_crm_cust_info(rows).orderBy("cst_id").collect()
    assert [r.cst_firstname for r in got] == ["Jon", "Amy", "Bo"]
    assert [r.cst_marital_status for r in got] == ["Married", "Single", "n/a"]
    assert [r.cst_gndr for r in got] == ["Male", "Female", "n/a"]


def test_latest_record_wins_and_an_unknown_date_beats_it(spark):
    rows = bronze(
        spark, "crm_cust_info",
        customer("1", "Old", date="2020-01-01"), customer(" 1", "New", date="2025-01-01"),
        customer("2", "Dated", date="2025-01-01"), customer("2", "Undated", date="unknown"),
        customer("3", "Known", date="2025-01-01"), customer("3", "FarOff", date="9999-12-31"),
        customer("", "Blank"), customer(" \t", "Spaces"))
    got = {r.cst_id: r.cst_firstname for r in silver.clean_crm_cust_info(rows).collect()}
    assert got == {1: "New", 2: "Undated", 3: "FarOff"}


def test_equal_dates_pick_the_same_record_every_time(spark):
    rows = [customer("1", name, date="2025-01-01") for name in ("Ann", "Bob", "Cid")]
    picked = {
        silver.clean_crm_cust_info(bronze(spark, "crm_cust_info", *order).repartition(3)).first().cst_firstname
        for order in (rows, rows[::-1])
    }
    assert len(picked) == 1


def test_non_numeric_customer_id_fails(spark):
    with pytest.raises(Exception, match="cst_id is not a whole number"):
        silver.clean_crm_cust_info(bronze(spark, "crm_cust_info", customer("x1"))).collect()


def test_product_key_split_and_cost(spark):
    rows = bronze(
        spark, "crm_prd_info",
        ("210", "CO-RF-FR-R92B-58", " Frame ", "", "R ", "2003-07-01", ""),
        ("211", "CO-RF-FR-R92R-58", "Frame", "12.9", "x", "bad", "2001-01-01"))
    one, two = silver.clean_crm_prd_info(rows).orderBy("prd_id").collect()
    assert (one.cat_id, one.prd_key, one.prd_cost, one.prd_line, one.prd_nm) == (
        "CO_RF", "FR-R92B-58", 0, "Road", "Frame")
    assert (two.prd_cost, two.prd_line, two.prd_start_dt, two.prd_end_dt) == (12, "n/a", None, dt.date(2001, 1, 1))


def sale(sales, quantity, price, order="20130316", ship="20130323"):
    return ("A", "P", "1", order, ship, "20130328", sales, quantity, price)


def test_sales_repair(spark):
    rows = bronze(
        spark, "crm_sales_details",
        sale("25", "1", "25"), sale("", "2", "10", order="0"), sale("999", "3", "-5", order="2013"))
    got = silver.clean_crm_sales_details(rows).orderBy("sls_quantity").collect()
    assert [r.sls_order_dt for r in got] == [dt.date(2013, 3, 16), None, None]
    assert [r.sls_sales for r in got] == [25, 20, 15]
    assert [r.sls_price for r in got] == [25, 10, 5]


@pytest.mark.parametrize("row, strict, lenient", [
    (sale("50", "2", ""), (None, None), (50, 25)),      # valid amount, missing price
    (sale("50", "", "25"), (None, 25), (50, 25)),       # valid amount, missing quantity
    (sale("7", "0", "5"), (0, 5), (0, 5)),              # quantity 0
    (sale("7", "0", "-5"), (0, None), (0, None)),       # quantity 0 and a price to rebuild
    (sale("", "2", "2.5"), (5, 2), (5, 2)),             # price ties go to the even side
    (sale("", "2", "3.5"), (7, 4), (7, 4)),
    (sale("", "", ""), (None, None), (None, None)),
])
def test_sales_repair_traps(spark, row, strict, lenient):
    rows = bronze(spark, "crm_sales_details", row)
    for want, flag in ((strict, True), (lenient, False)):
        got = silver.clean_crm_sales_details(rows, strict_null=flag).first()
        assert (got.sls_sales, got.sls_price) == want


def test_fractional_repaired_sales_fail(spark):
    with pytest.raises(Exception, match="not a whole number"):
        silver.clean_crm_sales_details(bronze(spark, "crm_sales_details", sale("", "1", "2.5"))).collect()


def test_erp_customers(spark):
    rows = bronze(
        spark, "erp_cust_az12", ("NASAW00011000", "1971-10-06", "F "), ("AW2 ", "2999-01-01", "MALE"),
        (" NASAW3", "2025-02-01", "x"), ("AW4", "2025-01-31", ""))
    got = silver.clean_erp_cust_az12(rows, as_of=dt.date(2025, 1, 31)).collect()
    assert [r.cid for r in got] == ["AW00011000", "AW2", "NASAW3", "AW4"]
    assert [r.bdate for r in got] == [dt.date(1971, 10, 6), None, None, dt.date(2025, 1, 31)]
    assert [r.gen for r in got] == ["Female", "Male", "n/a", "n/a"]


def test_locations(spark):
    rows = bronze(
        spark, "erp_loc_a101", ("AW-00011000", "US"), ("AW-2", " USA "), ("AW-3", "us"), ("AW-4", "\xa0"),
        ("AW-5", "DE"), ("AW-6", " France "))
    got = silver.clean_erp_loc_a101(rows).collect()
    assert got[0].cid == "AW00011000"
    assert [r.cntry for r in got] == ["United States", "United States", "us", "n/a", "Germany", "France"]


def test_categories_are_trimmed(spark):
    rows = bronze(spark, "erp_px_cat_g1v2", (" AC_BR ", "Accessories\t", "\xa0Bike Racks", "Yes"))
    assert tuple(silver.clean_erp_px_cat(rows).first()) == ("AC_BR", "Accessories", "Bike Racks", "Yes")


def test_a_hot_customer_is_reduced_before_the_shuffle(spark):
    rows = spark.range(10_000).select(
        F.lit(1).alias("id"), F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int")).alias("day"),
        F.col("id").alias("v"))
    latest = silver.latest_per(rows, "id", "day")
    assert [tuple(r) for r in latest.collect()] == [(1, dt.date(2020, 1, 1) + dt.timedelta(9999), 9999)]
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Window" not in plan
