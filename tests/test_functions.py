import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillroll.functions import dates, numbers, text


def test_strip_removes_what_python_strips(column):
    values = ["  a b ", "\ta\n", "\xa0a　", "\x1fa\x1c", "", " \t ", None, "a​"]
    assert column(text.strip, values) == [v.strip() if v is not None else None for v in values]


def test_blank_means_null_empty_or_spaces(column):
    assert column(text.is_blank, [None, "", " \t\xa0", " x "]) == [True, True, True, False]


def test_decode_code_ignores_case_and_padding(column):
    got = column(lambda c: text.decode_code(c, {"M": "Married", "S": "Single"}), ["M", " s\t", "", None, "X"])
    assert got == ["Married", "Single", "n/a", "n/a", "n/a"]


def test_compact_dates(column):
    values = ["20130316", " 20130316\xa0", "0", "2013", "20130230", "00000000", "2013-3-1", "2013031T", "+2013031",
              "201303160", "16770921", "16770922", "22620411", "22620412", "", None]
    want = [dt.date(2013, 3, 16)] * 2 + [None] * 9 + [dt.date(1677, 9, 22), dt.date(2262, 4, 11), None, None, None]
    assert column(dates.parse_compact_date, values) == want


def test_plain_texts_are_read_without_the_long_patterns(spark):
    rows = spark.createDataFrame([("20240229", "12")], "d string, n string").select(
        dates.parse_compact_date(F.col("d")).alias("d"), numbers.parse_number(F.col("n")).alias("n"),
        numbers.lookup_integer(F.col("n"), "n").alias("k"))
    text = rows._jdf.queryExecution().analyzed().toString()
    assert text.count("RLIKE") >= 4 and tuple(rows.first()) == (dt.date(2024, 2, 29), 12.0, 12)


def test_plain_and_odd_texts_mean_the_same(column):
    odd = ["20240229", " 20240229", "\u20280240229", "20240229\n", "\x0020240229", "20230229", "2024022", "202402291"]
    assert column(dates.parse_compact_date, odd) == [
        dt.date(2024, 2, 29), dt.date(2024, 2, 29), None, dt.date(2024, 2, 29), None, None, None, None]
    figures = ["0012", "12\n", "\x0012", "1" * 15, "9" * 16, "-7", "", "1e3", "\u0661"]
    assert column(numbers.parse_number, figures) == [
        12.0, 12.0, None, float("1" * 15), float("9" * 16), -7.0, None, 1000.0, None]


def test_iso_dates(column):
    values = ["2025-01-01", "2025-02-30", "2025-1-1", "2025", "someday", "2999-01-01", "", None]
    assert column(dates.parse_iso_date, values) == [dt.date(2025, 1, 1)] + [None] * 7


def test_numbers(column):
    values = ["12", " 12.5\t", "-3", "+4", ".5", "1e3", "1d", "0x10", "NaN", "Infinity", "", "1 2", None]
    want = [12.0, 12.5, -3.0, 4.0, 0.5, 1000.0] + [None] * 7
    assert column(numbers.parse_number, values) == want


def test_lookup_integer(column):
    got = column(lambda c: numbers.lookup_integer(c, "id"), ["17", "17.0", " 9007199254740993 ", "x", "", None])
    assert got == [17, 17, 9007199254740993, None, None, None]


@pytest.mark.parametrize("value", ["1.5", "abc"])
def test_strict_integer_fails_the_job(column, value):
    with pytest.raises(Exception, match="not a whole number"):
        column(lambda c: numbers.strict_integer(c, "cst_id"), [value])


def test_whole_fails_on_a_fraction(column):
    assert column(lambda c: numbers.whole(c, "x"), [2.0, None, -3.0], "double") == [2, None, -3]
    with pytest.raises(Exception, match="not a whole number"):
        column(lambda c: numbers.whole(c, "x"), [2.5], "double")


def test_boundary_differences(spark):
    row = spark.range(1).select(
        dates.months_crossed(F.lit(dt.date(2020, 1, 31)), F.lit(dt.date(2020, 2, 1))).alias("short"),
        dates.months_crossed(F.lit(dt.date(2020, 1, 1)), F.lit(dt.date(2020, 1, 31))).alias("same"),
        dates.months_crossed(F.lit(dt.date(2019, 12, 31)), F.lit(dt.date(2021, 1, 1))).alias("long"),
        dates.years_crossed(F.lit(dt.date(2019, 12, 31)), F.lit(dt.date(2020, 1, 1))).alias("years"),
    ).first()
    assert row.asDict() == {"short": 1, "same": 0, "long": 13, "years": 1}


def test_integer_and_exact_means(spark):
    rows = spark.createDataFrame([(1,), (2,), (2,), (None,)], "x long")
    empty = rows.where("x > 9")
    assert rows.agg(numbers.int_mean(F.col("x"))).first()[0] == 1
    assert rows.agg(numbers.mean(F.col("x"), exact=True)).first()[0] == pytest.approx(5 / 3)
    assert empty.agg(numbers.int_mean(F.col("x"))).first()[0] is None


def test_rendered_numbers_round_like_python(column):
    values = [0.25, 0.15, 2.5, 1234567.891, 0.0, -12.35]
    assert column(lambda c: text.plain_number(c, 1), values, "double") == [f"{v:.1f}" for v in values]
    assert column(text.grouped_number, values, "double") == [f"{v:,.0f}" for v in values]
