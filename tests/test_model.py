import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillroll import schemas
from tillroll.operators import frames, insights, snapshot
from tillroll.plans.sales_model import SALES_COLUMNS, apply_filters, build_sales, filter_options

AS_OF = dt.date(2025, 1, 31)


def day(year, month, number=1):
    return dt.date(year, month, number)


@pytest.fixture
def star(spark):
    def line(order, product, customer, date, amount, quantity=1):
        return (order, product, customer, date, None, None, amount, quantity, amount)

    fact = [
        line("S1", 1, 1, day(2011, 5), 100, 2), line("S1", 2, 1, day(2011, 5), 50),
        line("S2", 1, 1, day(2012, 6), 6000, 3), line("S3", 2, 2, day(2012, 6), 40),
        line("S4", 9, 2, day(2012, 7), 30), line("S5", 1, None, day(2012, 8), 20),
        line("S6", 1, 77, day(2012, 8), 10), line("S7", 1, 1, None, 999),
    ]
    products = [(1, 1, "P1", "Bike", "c", "Bikes", "Road", "Yes", 10, "Road", None),
                (2, 2, "P2", "Cap", "c", "Clothing", "Caps", "Yes", None, "Road", None)]
    customers = [(1, 1, "AW0001", "Ann", "Lee", "Germany", "Single", "Female", day(1990, 1), None),
                 (2, 2, "AW0002", None, "Ray", "France", "Single", "Male", None, None)]
    return (spark.createDataFrame(fact, schemas.FACT_SALES), spark.createDataFrame(products, schemas.DIM_PRODUCTS),
            spark.createDataFrame(customers, schemas.DIM_CUSTOMERS))


@pytest.fixture
def sales(star):
    return build_sales(*star, as_of=AS_OF)


def test_frame(sales):
    assert tuple(sales.columns) == SALES_COLUMNS == tuple(schemas.SALES.fieldNames())
    got = {(r.order_number, r.product_key): r for r in sales.collect()}
    assert len(got) == 7                                            # the undated line is gone
    assert got["S1", 1].profit == 80 and got["S1", 2].profit is None
    assert [got[k].is_returning for k in (("S1", 1), ("S2", 1), ("S5", 1), ("S6", 1))] == [False, True, False, False]
    assert got["S1", 1].customer_segment == "VIP" and got["S3", 2].customer_segment == "New"
    assert got["S1", 1].age_group == "30-39" and got["S3", 2].age_group == "50 and above"
    assert got["S6", 1].customer_segment is None and got["S6", 1].age_group is None     # dangling key
    assert got["S4", 9].category is None
    assert got["S2", 1].order_month == day(2012, 6) and got["S2", 1].order_year == 2012


def test_saved_segments_are_used_as_they_are(spark, star):
    saved = spark.createDataFrame([(1, "Gold", "old")], "customer_key long, customer_segment string, age_group string")
    got = {r.customer_key: r.customer_segment for r in build_sales(*star, saved).collect()}
    assert got == {1: "Gold", 2: None, None: None, 77: None}


def test_columns_limit_the_joins(star):
    plan = build_sales(*star, columns=["order_month", "sales_amount"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    plan = build_sales(*star, columns=["category", "sales_amount"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_options(sales):
    got = [(r.field, r.value) for r in filter_options(sales).collect()]
    assert got == [
        ("min_date", "2011-05-01"), ("max_date", "2012-08-01"), ("category", "Bikes"), ("category", "Clothing"),
        ("country", "France"), ("country", "Germany"), ("customer_segment", "New"), ("customer_segment", "VIP")]


def test_filters(sales):
    def orders(*args, **kwargs):
        return sorted({r.order_number for r in apply_filters(sales, *args, **kwargs).collect()})

    everything = orders()
    assert everything == ["S1", "S2", "S3", "S4", "S5", "S6"]
    assert orders((day(2012, 6), day(2012, 7))) == ["S2", "S3", "S4"]           # both ends inclusive
    assert orders(("2012-06-01", "2012-06-01")) == ["S2", "S3"]
    assert orders((day(2012, 6), None)) == orders((day(2012, 6),)) == orders(()) == everything
    assert orders(categories=["Clothing"]) == ["S1", "S3"]
    assert orders(countries=["Germany"], segments=["VIP"]) == ["S1", "S2"]
    assert orders((day(1900, 1), day(1900, 12))) == []


def test_returning_looks_at_the_whole_history(sales):
    later = apply_filters(sales, (day(2012, 1), day(2012, 12)))
    assert {r.order_number for r in later.where("is_returning").collect()} == {"S2"}


# --- insights, charts, snapshot ------------------------------------------------------------

def empty(sales):
    return apply_filters(sales, (day(1900, 1), day(1900, 12)))


def test_kpis(sales):
    got = insights.kpis(sales).first()
    assert (got.revenue, got.orders, got.customers, got.units) == (6250.0, 6, 3, 10)
    assert got.aov == pytest.approx(6250 / 6) and got.items_per_order == pytest.approx(10 / 6)
    nothing = insights.kpis(empty(sales)).first()
    assert set(nothing) == {0}
    assert insights.revenue_per_customer(empty(sales)).first()[0] is None


def test_cards(sales):
    cards = {r.id: r for r in insights.all_insights(sales).collect()}
    assert list(cards) == list(insights.CARD_TEXT)
    assert cards["category_concentration"].metric == "98.6%" and "**Bikes**" in cards["category_concentration"].takeaway
    assert cards["repeat_customer_value"].metric == "100% of revenue"    # 6220 of 6250
    assert "**67%** of customers" in cards["repeat_customer_value"].takeaway    # 77 bought once, NULL is nobody
    assert "**2012**" in cards["returning_growth"].takeaway
    assert "Germany + France" in cards["market_concentration"].takeaway
    # July and August both sold 30, the earlier month is named
    assert "**June** is the strongest month and **July** the weakest" in cards["seasonality"].takeaway
    assert all(r.title and r.metric and r.takeaway and r.action for r in cards.values())


def test_no_cards_on_an_empty_frame(sales):
    assert insights.all_insights(empty(sales)).count() == 0


def test_ties_go_to_the_first_label(spark):
    rows = spark.createDataFrame(
        [("b", 5, day(2020, 2)), ("a", 5, day(2020, 1)), ("c", 1, day(2020, 3)), (None, 99, None)],
        "category string, sales_amount long, order_date date")
    assert insights.category_concentration(rows).first().category == "a"
    assert insights.seasonality(rows).first()[:2] == (1, 3)
    top = frames.top_by_revenue(rows, "category", 2).collect()
    assert [r.category for r in top] == ["a", "b"]


def test_insights_without_a_base_are_left_out(spark):
    rows = spark.createDataFrame(
        [("a", 0, 0, day(2020, 2), 2020, False, "x", 1, "S")],
        "category string, sales_amount long, profit long, order_date date, order_year int, is_returning boolean, "
        "country string, customer_key long, order_number string")
    assert insights.all_insights(rows).count() == 0


def test_sold_cost_bands_are_dense_and_right_closed(spark):
    rows = spark.createDataFrame(
        [(1, 100), (2, 500), (3, 501), (3, 501), (4, None), (5, 0), (None, None)], "product_key long, cost long")
    got = [(r.cost_range, r.products) for r in frames.cost_segmentation(rows).collect()]
    assert got == [("Below 100", 2), ("100-500", 1), ("500-1000", 1), ("Above 1000", 0)]


def test_calendar_has_gaps_as_null(sales):
    got = {r.month_name: r.sales_amount for r in frames.revenue_by_calendar_month(sales).collect()}
    assert len(got) == 12 and got["Jan"] is None and got["Jun"] == 6040


def test_snapshot_holds_no_personal_data(sales):
    rows = snapshot.snapshot(sales).collect()
    text = "\n".join(r.line for r in snapshot.snapshot_lines(sales).collect()) + repr(rows)
    for private in ("Ann", "Lee", "Ray", "AW000", "birthdate", "1990"):
        assert private not in text
    assert "Revenue" in text and "margin" in text
    with pytest.raises(ValueError):
        snapshot.top_figures(sales, "customer_key")


def test_snapshot_lines(sales):
    lines = [r.line for r in snapshot.snapshot_lines(sales).collect()]
    assert lines[0] == snapshot.HEADING and lines[1].startswith("- Revenue: 6,250; Gross profit: ")
    assert "- Revenue by year: 2011: 150, 2012: 6,100" in lines
    assert "- Top countries: Germany: 6,150, France: 70" in lines
    assert lines[-1] == "- Top products: Bike: 6,130, Cap: 90"


def test_snapshot_of_nothing(sales):
    assert [r.line for r in snapshot.snapshot_lines(empty(sales)).collect()] == [snapshot.NO_DATA]
    assert [(r.section, r.key) for r in snapshot.snapshot(empty(sales)).collect()] == [("no_data", snapshot.NO_DATA)]
