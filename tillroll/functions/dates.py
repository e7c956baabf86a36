"""Date expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from tillroll.functions.text import padded

# Fixed value: nanoseconds per day. A text date whose nanoseconds do not fit 64 bits (before
# 1677-09-22 or after 2262-04-11) reads as unknown.
DAY_NANOS = 86_400_000_000_000

_ISO_DATE = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})$"
_PLAIN_DATE = r"^ ?[0-9]{8}\z"
_COMPACT_DATE = padded("[0-9]{8}")


def as_of_date(as_of: dt.date | Column | None) -> Column:
    """The reporting day: the one given, else today."""
    if as_of is None:
        return F.current_date()
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def _in_nanos(d: Column) -> Column:
    """The date, NULL when its nanoseconds overflow; ``d`` is evaluated once."""
    nanos = F.try_multiply(F.unix_date(d).cast("bigint"), F.lit(DAY_NANOS))
    return F.date_from_unix_date(F.call_function("div", nanos, F.lit(DAY_NANOS)).cast("int"))


def parse_iso_date(c: Column) -> Column:
    """``yyyy-MM-dd`` text to date; unparsable text is NULL."""
    return _in_nanos(F.regexp_extract(c, _ISO_DATE, 1).try_cast("date"))


def parse_compact_date(c: Column) -> Column:
    """``yyyyMMdd`` text to date; anything but eight digits of a real day is NULL.

    Digits after a plain space or none, the usual case, are read without the long pattern. Other text leaves
    dashes alone, which is no date.
    """
    digits = F.when(c.rlike(_PLAIN_DATE), F.trim(c)).otherwise(F.regexp_extract(c, _COMPACT_DATE, 1))
    parts = [F.substring(digits, at, n) for at, n in ((1, 4), (5, 2), (7, 2))]
    return _in_nanos(F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2]).try_cast("date"))


def months_crossed(start: Column, end: Column) -> Column:
    """Month boundaries between two dates: 31 January to 1 February is one."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def years_crossed(start: Column, end: Column) -> Column:
    """Year boundaries between two dates."""
    return F.year(end) - F.year(start)


def month_start(d: Column) -> Column:
    return F.trunc(d, "MM")


def year_start(d: Column) -> Column:
    return F.trunc(d, "YEAR")


def month_name(month: Column) -> Column:
    """English name of a month number."""
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMMM")
