import datetime as dt

import pytest

from tillroll import schemas
from tillroll.operators import explore, quality, ranking, reports, segments, totals, trend

AS_OF = dt.date(2025, 1, 31)


def lines(spark, *rows):
    """(order, product, customer, date, amount, quantity) as sales lines."""
    return spark.createDataFrame(
        [(o, p, c, d, None, None, a, q, a // q if q else None) for o, p, c, d, a, q in rows], schemas.FACT_SALES)


def products(spark, *rows):
    """(key, name, category, cost) as products."""
    return spark.createDataFrame(
        [(k, k, str(k), n, "c", cat, "s", "Yes", cost, "Road", None) for k, n, cat, cost in rows], schemas.DIM_PRODUCTS)


def customers(spark, *rows):
    """(key, first, last, birthdate) as customers."""
    return spark.createDataFrame(
        [(k, k, f"AW{k}", f, last, "Germany", "Single", "Male", b, None) for k, f, last, b in rows],
        schemas.DIM_CUSTOMERS)


def d(year, month=1, number=1):
    return dt.date(year, month, number)


def test_catalogue_cost_bands(spark):
    items = products(spark, *[(i, "x", None, cost) for i, cost in enumerate([99, 100, 500, 501, 1000, 1001, None])])
    got = {r.cost_range: r.total_products for r in segments.products_by_cost_band(items).collect()}
    assert got == {"Below 100": 1, "100-500": 2, "500-1000": 2, "Above 1000": 2}


def test_null_groups_are_kept(spark):
    got = explore.products_by_category(products(spark, (1, "a", None, 1), (2, "b", "B", 3), (3, "c", "B", 4))).collect()
    assert [tuple(r) for r in got] == [("B", 2), (None, 1)]
    costs = explore.average_cost_by_category(products(spark, (2, "b", "B", 3), (3, "c", "B", 4))).first()
    assert costs.avg_cost == 3


def test_ranks_keep_ties(spark):
    sold = lines(spark, *[(str(i), i, 1, d(2020), amount, 1) for i, amount in enumerate([9, 8, 7, 6, 5, 5, 1])])
    names = products(spark, *[(i, f"p{i}", "c", 1) for i in range(7)])
    got = sorted((r.rank_products, r.product_name) for r in ranking.ranked_products(sold, names).collect())
    assert got == [(1, "p0"), (2, "p1"), (3, "p2"), (4, "p3"), (5, "p4"), (5, "p5")]
    assert [r.product_name for r in ranking.top_products(sold, names).collect()] == ["p0", "p1", "p2", "p3", "p4"]
    assert [r.product_name for r in ranking.bottom_products(sold, names, 2).collect()] == ["p6", "p4"]


def test_previous_year_is_the_previous_sold_year(spark):
    sold = lines(spark, ("1", 1, 1, d(2010), 10, 1), ("2", 1, 1, d(2013), 15, 1), ("3", 1, 1, d(2014), 15, 1),
                 ("4", 1, 1, None, 99, 1))
    got = trend.product_performance(sold, products(spark, (1, "p", "c", 1))).collect()
    assert [(r.order_year, r.avg_sales, r.avg_change, r.py_sales, r.diff_py, r.py_change) for r in got] == [
        (2010, 13, "Below Avg", None, None, "No Change"),
        (2013, 13, "Above Avg", 10, 5, "Increase"),
        (2014, 13, "Above Avg", 15, 0, "No Change")]


def test_exact_mean_year(spark):
    sold = lines(spark, ("1", 1, 1, d(2010), 10, 1), ("2", 1, 1, d(2011), 15, 1))
    got = trend.product_performance(sold, products(spark, (1, "p", "c", 1)), exact=True).collect()
    assert [(r.avg_sales, r.diff_avg, r.avg_change) for r in got] == [(12.5, -2.5, "Below Avg"), (12.5, 2.5, "Above Avg")]


def test_running_totals(spark):
    sold = lines(spark, ("1", 1, 1, d(2010, 1), 10, 1), ("2", 1, 1, d(2010, 3), 15, 1), ("3", 1, 1, d(2011), 40, 1))
    got = [tuple(r) for r in trend.running_totals(sold).collect()]
    assert sorted(got) == [(d(2010), 25, 25, 12), (d(2011), 40, 65, 26)]
    assert trend.running_totals(sold, "month").count() == 3
    exact = {r.order_date: r.moving_average_price for r in trend.running_totals(sold, exact=True).collect()}
    assert exact == {d(2010): 12.5, d(2011): 26.25}


def test_month_text_sorts_as_text(spark):
    sold = lines(spark, ("1", 1, 1, d(2010, 1), 10, 1), ("2", 1, 1, d(2010, 4), 15, 1))
    assert [r.order_date for r in trend.activity_by_month_text(sold).collect()] == ["2010-Apr", "2010-Jan"]


def test_customer_report(spark):
    sold = lines(
        spark, ("1", 1, 1, d(2020, 1, 31), 6000, 2), ("1", 2, 1, d(2020, 1, 31), 1, 1),
        ("2", 1, 1, d(2021, 2, 1), 2, 1), ("3", 1, 2, d(2021, 1), 7, 1), ("4", 1, 8, d(2021, 1), 5, 1),
        ("4", 2, 9, d(2021, 1), 5, 1), ("5", 1, 1, None, 999, 1))
    people = customers(spark, (1, None, "Lee", d(1996, 12, 31)), (2, "Bo", None, None), (3, "No", "Order", None))
    got = {r.customer_key: r for r in reports.report_customers(sold, people, AS_OF).collect()}
    assert set(got) == {1, 2, None}
    one = got[1]
    assert (one.customer_name, one.age, one.age_group, one.customer_segment) == (" Lee", 29, "20-29", "VIP")
    assert (one.total_orders, one.total_products, one.lifespan, one.recency) == (2, 2, 13, 47)
    assert (one.avg_order_value, one.avg_monthly_spend) == (3001, 461)
    assert (got[2].age_group, got[2].customer_segment, got[2].avg_monthly_spend) == ("50 and above", "New", 7)
    # two dangling customers share one order: one group, one order, two products
    assert (got[None].total_orders, got[None].total_products, got[None].total_sales) == (1, 2, 10)
    assert got[None].customer_name == " "


def test_historical_layout(spark):
    sold = lines(spark, ("1", 1, 1, d(2020, 1), 5, 1), ("2", 2, 1, d(2020, 9), 5, 1))
    people = customers(spark, (1, "A", "B", None))
    report = reports.report_customers(sold, people, AS_OF, as_written=True)
    assert "total_products" not in report.columns and len(report.columns) == 14
    row = report.first()
    assert row.lifespan == 2 and row.avg_monthly_spend == 10 // 8


def test_product_report(spark):
    sold = lines(spark, ("1", 1, 1, d(2020, 1), 10, 3), ("2", 1, 2, d(2020, 5), 50_000, 2), ("3", 2, 1, d(2020), 7, 0))
    got = {r.product_key: r for r in reports.report_products(
        sold, products(spark, (1, "p", "c", 1), (2, "q", "c", 1)), AS_OF).collect()}
    assert got[1].avg_selling_price == pytest.approx(round((10 / 3 + 25_000) / 2, 1))
    assert (got[1].product_segment, got[1].total_customers, got[1].avg_monthly_revenue) == ("High-Performer", 2, 12_502)
    assert (got[2].avg_selling_price, got[2].product_segment) == (None, "Low-Performer")


def test_verified_keys_give_the_same_report(spark):
    sold = lines(spark, ("1", 1, 1, d(2020, 1), 10, 3), ("2", 1, None, d(2020, 5), 50, 2), ("3", 2, 1, d(2020), 7, 1))
    people = customers(spark, (1, "A", "B", None))
    plain, trusted = (
        sorted(map(repr, reports.report_customers(sold, people, AS_OF, keys_verified=v).collect())) for v in (False, True))
    assert plain == trusted
    plain, trusted = (
        [tuple(r) for r in ranking.fewest_orders(sold, people, keys_verified=v).collect()] for v in (False, True))
    assert plain == trusted == [(None, None, None, 1), (1, "A", "B", 2)]


def test_segments_use_undated_spend(spark):
    sold = lines(spark, ("1", 1, 1, d(2020), 10, 1), ("2", 1, 1, d(2021), 10, 1), ("3", 1, 1, None, 5000, 1),
                 ("4", 1, 2, None, 9999, 1))
    got = segments.customers_by_segment(sold, customers(spark, (1, "A", "B", None), (2, "C", "D", None))).collect()
    assert {r.customer_segment: r.total_customers for r in got} == {"VIP": 1, "New": 1}


def test_dangling_keys_meet_in_one_group(spark):
    sold = lines(spark, ("1", 8, 1, d(2020), 1, 1), ("2", 9, 1, d(2020), 2, 1), ("3", None, 1, d(2020), 4, 1),
                 ("4", 1, 1, d(2020), 8, 1))
    items = products(spark, (1, "p", "c", 1))
    assert {r.category: r.total_revenue for r in explore.revenue_by_category(sold, items).collect()} == {"c": 8, None: 7}
    assert totals.resolve_keys(sold, items, "product_key").where("product_key is null").count() == 3
    orphans = {r.product_key: r.lines for r in quality.orphan_keys(sold, items, "product_key").collect()}
    assert orphans == {8: 1, 9: 1, None: 1}


def test_shares_of_nothing(spark):
    sold = lines(spark, ("1", 1, 1, d(2020), 0, 1))
    row = trend.category_shares(sold, products(spark, (1, "p", "c", 1))).first()
    assert (row.overall_sales, row.percentage_of_total) == (0, None)


def test_reconciliation(spark):
    left, right = lines(spark, ("1", 1, 1, d(2020), 100_000, 1)), lines(spark, ("1", 1, 1, d(2020), 100_011, 1))
    row = quality.revenue_reconciliation(left, right).first()
    assert not row.within_tolerance and row.relative_difference == pytest.approx(11 / 100_011)
    counts = quality.row_count_match({"a": left}, {"a": left.union(right)}).first()
    assert tuple(counts) == ("a", 1, 2, False)
