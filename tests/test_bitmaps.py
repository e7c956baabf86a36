"""Distinct counts by bitmaps, and report parts straight from the star."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fixtures.star import dim_customers, dim_products, dirty_fact_sales
from tillroll.operators import insights, snapshot
from tillroll.operators.bitmaps import count_keys, key_bitmaps, key_spans, merged, number_of_keys
from tillroll.plans import sales_model, star_parts

TEXTS = ["SO43697", "SO43698", "SO043697", "43697", "043697", "", "0", "00", "-1", "1", "+1", " 1", "1 ", "x", "é7", "７",
         "9" * 18, "9" * 19, "1" + "9" * 18, "a" + "9" * 40, "b" + "9" * 40, "a" + "8" + "9" * 39, None, None, "SO43697"]
NUMBERS = [0, 1, -1, 32767, 32768, 32769, -32767, -32768, -32769, 2**62, -2**62, 5, 5, None, 1_000_000_007]


@pytest.mark.parametrize("values, kind", [(TEXTS, "string"), (NUMBERS, "long"), ([None, None], "long"), ([], "string")])
def test_every_key_counts_once(spark, values, kind):
    rows = spark.createDataFrame([(v, 1) for v in values] * 3, f"k {kind}, n int").repartition(4)
    assert count_keys(rows, "k", "n").first().n == len({v for v in values if v is not None})
    assert key_bitmaps(rows, "k", (), F.sum("n").alias("n")).agg(F.sum("n").alias("n")).first().n == (3 * len(values) or None)


def test_bitmaps_add_up(spark):
    draw = random.Random(4)
    pairs = [(draw.randrange(12), f"SO{draw.randrange(90_000)}" if draw.random() < 0.95 else None) for _ in range(20_000)]
    rows = spark.createDataFrame(pairs, "month int, k string").repartition(5)
    monthly = key_bitmaps(rows, "k", ["month"])
    by_month = {r.month: r.n for r in monthly.groupBy("month").agg(number_of_keys().alias("n")).collect()}
    assert by_month == {m: len({k for n, k in pairs if n == m and k}) for m in range(12)}
    assert merged(monthly).agg(number_of_keys().alias("n")).first().n == len({k for _, k in pairs if k})
    halves = merged(monthly.withColumn("half", F.col("month") < 6), "half").groupBy("half").agg(number_of_keys().alias("n"))
    assert {r.half: r.n for r in halves.collect()} == {
        h: len({k for m, k in pairs if k and (m < 6) == h}) for h in (True, False)}


def test_spans_tell_one_key_from_several(spark):
    cases = {1: ["SO1"], 2: ["SO1", "SO1"], 3: ["SO1", "SO2"], 4: ["7", "007"], 5: [None], 6: [None, "A"], 7: ["A1", "B1"],
             8: ["x" + "1" * 30, "y" + "1" * 30], 9: ["", None], 10: ["", "0"], 11: ["9", "17"], 12: ["17", "9", "A3"]}
    rows = spark.createDataFrame([(g, k) for g, keys in cases.items() for k in keys], "g int, k string")
    spans = key_spans(rows, "k", ["g"], F.count("*").alias("n")).groupBy("g").agg(
        (F.min("first") < F.max("last")).alias("several"), F.sum("n").alias("n"))
    got = {r.g: (bool(r.several), r.n) for r in spans.collect()}
    assert got == {g: (len({k for k in keys if k is not None}) > 1, len(keys)) for g, keys in cases.items()}
    # spans of finer groups add up: each number in a group of its own, and integer keys of both signs
    numbers = spark.createDataFrame([(g, n) for g, some in enumerate(([9, 17], [-3, 3], [-9, -17], [4, 4], [-4])) for n in some],
                                    "g int, n long")
    spans = key_spans(numbers, "n", ["g", (F.col("n") % 5).alias("part")]).groupBy("g").agg(
        (F.min("first") < F.max("last")).alias("several"))
    assert {r.g: r.several for r in spans.collect()} == {0: True, 1: True, 2: True, 3: False, 4: False}


def star(spark, sf_dir):
    return dirty_fact_sales(spark, sf_dir), dim_products(spark, sf_dir), dim_customers(spark, sf_dir)


FILTERS = [{}, {"categories": ["ECONOMY", "PROMO"]}, {"countries": ["NATION_1", "NATION_2", "NATION_3"]},
           {"segments": ["VIP", "New"]}, {"date_range": (dt.date(1996, 2, 11), dt.date(1997, 3, 5))}, entry.SLICE]


@pytest.mark.parametrize("filters", FILTERS, ids=lambda f: "-".join(f) or "all")
def test_parts_of_the_star_equal_those_of_the_frame(spark, sf_dir, filters):
    """Dirty keys included: dangling and missing ones count in the sums and never as a label."""
    fact, products, customers = star(spark, sf_dir)
    frame = sales_model.apply_filters(
        sales_model.build_sales(fact, products, customers, as_of=entry.AS_OF, segment_spend=entry.HIGH_SPEND), **filters)
    profile = star_parts.profile_of(fact.where("order_date is not null"), customers, entry.AS_OF, segment_spend=entry.HIGH_SPEND)
    lines = star_parts.star_lines(fact, products, profile, **filters)
    parts = {"products": star_parts.product_part(lines, products).cache(), "orders": star_parts.order_part(lines),
             "customers": star_parts.customer_part(star_parts.customer_months(lines), profile).cache()}
    whole = insights.report_parts(frame.cache())

    def both(op):
        return sorted(map(str, op(parts).collect())), sorted(map(str, op(whole).collect()))

    assert whole["customers"].count() > 5
    for op in (insights.cards_of, snapshot.snapshot_of, insights.kpis_of):
        mine, theirs = both(op)
        assert mine == theirs
    assert insights.kpis_of(parts).collect() == insights.kpis_with_lines(frame).collect()
    assert insights.repeat_customer_value(frame).collect() == insights.repeat_customer_value(parts["customers"]).collect()


def test_sums_by_month_tell_the_profile(spark, sf_dir):
    fact, _, customers = star(spark, sf_dir)
    dated = fact.where("order_date is not null")
    one, two = (star_parts.profile_of(rows, customers, entry.AS_OF, segment_spend=entry.HIGH_SPEND)
                for rows in (dated, star_parts.customer_months(dated)))
    assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0
