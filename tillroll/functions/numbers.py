"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tillroll.functions.text import padded, strip

_NUMBER = padded(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_DIGITS = r"^[0-9]{1,15}\z"  # exact as a double
_INTEGER = padded("[+-]?[0-9]+")


def parse_number(c: Column) -> Column:
    """Text to double; text that is no finite decimal number is NULL.

    Plain digits, the usual case, are read without the long pattern. No match is no text to cast, as a
    failed cast costs an exception.
    """
    found = F.nullif(F.regexp_extract(c, _NUMBER, 1), F.lit(""))
    return F.when(c.rlike(_DIGITS), c.try_cast("bigint").cast("double")).otherwise(found.try_cast("double"))


def strict_integer(c: Column, what: str) -> Column:
    """Text to bigint; text that is no whole number fails the job."""
    failure = F.raise_error(F.concat(F.lit(f"{what} is not a whole number: "), F.coalesce(c, F.lit("NULL"))))
    return F.coalesce(F.regexp_extract(c, _INTEGER, 1).try_cast("bigint"), failure.cast("bigint"))


def is_whole(c: Column) -> Column:
    """True for a number without a fraction and for NULL."""
    return F.coalesce(c == F.floor(c), F.lit(True))


def whole(c: Column, what: str) -> Column:
    """Double to bigint; a fraction fails the job instead of being cut off."""
    return F.when(is_whole(c), c.cast("bigint")).otherwise(F.raise_error(F.lit(f"{what} is not a whole number")))


def lookup_integer(c: Column, what: str) -> Column:
    """Text key to bigint: ``'17'`` and ``'17.0'`` read as 17, other text as NULL."""
    return F.when(c.rlike(_DIGITS), c.try_cast("bigint")).otherwise(
        F.coalesce(strip(c).try_cast("bigint"), whole(parse_number(c), what)))


def int_divide(a: Column, b: Column) -> Column:
    """Integer division that drops the remainder; NULL when the divisor is 0."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def int_mean(c: Column) -> Column:
    """Aggregate: mean of an integer column without its fraction."""
    return int_divide(F.sum(c), F.count(c))


def mean(c: Column, exact: bool = False) -> Column:
    """Aggregate: ``int_mean``, or the double mean when ``exact``."""
    return F.avg(c) if exact else int_mean(c)


def total(c: Column) -> Column:
    """Aggregate: sum that is 0, not NULL, when there is nothing to add."""
    return F.coalesce(F.sum(c), F.lit(0))


def percent(part: Column, base: Column) -> Column:
    """``part / base * 100`` as double; NULL when the base is 0."""
    return F.try_divide(part.cast("double"), base.cast("double")) * 100
