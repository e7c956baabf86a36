"""Distinct counts that add up: bitmaps over keys.

A key's number picks a bucket of 32,768 neighbours and a bit in it. Tasks send one bitmap for each
bucket they meet, not their keys, and bitmaps of parts can be merged where counts cannot be added.
Counts are exact for any key. They are cheapest for dense surrogate keys and for sequential order
numbers, of which a few kilobytes hold tens of thousands.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

_DIGITS = "0123456789"
_MOST_DIGITS = 18  # so many always fit 64 bits
_PLACE = ("_head", "_bucket")


def _with_head_and_number(rows: DataFrame, key: str) -> DataFrame:
    """The rows with their key as a text and a whole number, which together tell it from every other key.

    Integer keys are the number. Text is cut before its last digits, and a 1 is put before these, so
    that 007 and 7 differ and neighbours stay neighbours.
    """
    kind, text = rows.schema[key].dataType, F.col(key)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return rows.withColumns({"_head": F.lit(None).cast("string"), "_number": text.cast("bigint")})
    # a step of its own, so that the text is cut once however often the rest is used
    cut = rows.withColumn("_rest", F.rtrim(text.cast("string"), F.lit(_DIGITS)))
    digits = F.octet_length(text.cast("string")) - F.octet_length("_rest")
    head = F.when(digits > _MOST_DIGITS, F.left(text, F.char_length(text) - _MOST_DIGITS)).otherwise(F.col("_rest"))
    number = F.concat(F.lit("1"), F.right(text, F.least(digits, F.lit(_MOST_DIGITS)))).cast("bigint")
    return cut.withColumns({"_head": head, "_number": number}).drop("_rest")


def key_bitmaps(rows: DataFrame, key: str, by: Sequence[str | Column] = (), *sums: Column) -> DataFrame:
    """The keys of each group as bitmaps: one row, with ``bits``, for each bucket that occurs.

    ``sums`` are further aggregates, over the rows of the bucket. Rows without a key have a bucket
    of their own, with no bit set, so that sums over all buckets are sums over all rows.
    """
    return _with_head_and_number(rows, key).groupBy(
        *by, "_head", F.bitmap_bucket_number("_number").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_number")).alias("bits"), *sums)


def key_spans(rows: DataFrame, key: str, by: Sequence[str | Column], *sums: Column) -> DataFrame:
    """``sums`` by group, with ``first`` and ``last``, texts that differ if the group has two keys or more.

    A group has a row for each head its keys begin with, mostly one, so take the least ``first`` and
    the greatest ``last`` of its rows. Heads are grouped and numbers compared: tasks hash and never sort.
    """
    spans = _with_head_and_number(rows, key).groupBy(*by, "_head").agg(
        F.min("_number").alias("_least"), F.max("_number").alias("_most"), *sums)
    # sixteen hex digits, the sign bit turned over: texts of one head sort as its numbers do
    named = {name: F.concat(F.coalesce("_head", F.lit("")), F.lit("/"),
                            F.lpad(F.hex(F.col(c).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
             for name, c in (("first", "_least"), ("last", "_most"))}
    return spans.withColumns(named).drop("_head", "_least", "_most")


def merged(bitmaps: DataFrame, *by: str) -> DataFrame:
    """Bitmaps of fewer or no groups, from those of more."""
    return bitmaps.groupBy(*by, *_PLACE).agg(F.bitmap_or_agg("bits").alias("bits"))


def number_of_keys(bits: str = "bits") -> Column:
    """Aggregate: the keys in bitmaps of one group, each bucket of which has one row."""
    return F.coalesce(F.sum(F.bitmap_count(bits)), F.lit(0)).cast("bigint")


def count_keys(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The number of distinct known keys, in one row."""
    return key_bitmaps(rows, key).agg(number_of_keys().alias(name))
