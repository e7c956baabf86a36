"""Surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

_BITS = 16
_LEVELS = 4


def dense_keys(ids: DataFrame, id_column: str, key_name: str, *tie_break: str) -> DataFrame:
    """The rows of a unique bigint id, numbered 1..n in its order without one global sort.

    Ids that share all but their last 16 bits are numbered in one leaf, leaves that share all but
    16 further bits are counted in one branch, and so on for four levels. So no window holds more
    than 2^16 rows, however the ids are spread. All of it depends on id values only: a recomputed
    task gives the same keys. Number a narrow table, and join attributes to it afterwards.
    """
    def rows_before(window: WindowSpec) -> Column:
        return F.coalesce(F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    numbered = ids.withColumn("_g1", F.shiftright(id_column, _BITS))
    numbered = numbered.withColumn(
        "_position", F.row_number().over(Window.partitionBy("_g1").orderBy(id_column, *tie_break)))
    # groups of each level with their rows; a group starts where those before it in its parent end
    groups = [numbered.groupBy("_g1").agg(F.max("_position").cast("bigint").alias("_n"))]
    for level in range(2, _LEVELS):
        groups.append(
            groups[-1].withColumn(f"_g{level}", F.shiftright(f"_g{level - 1}", _BITS))
            .groupBy(f"_g{level}").agg(F.sum("_n").alias("_n")))
    top = f"_g{_LEVELS - 1}"
    starts = groups[-1].select(top, rows_before(Window.orderBy(top)).alias("_start"))  # 2^16 groups at most
    for level in range(_LEVELS - 2, 0, -1):
        here, parent = f"_g{level}", f"_g{level + 1}"
        inside = groups[level - 1].withColumn(parent, F.shiftright(here, _BITS)).withColumn(
            "_before", rows_before(Window.partitionBy(parent).orderBy(here)))
        starts = inside.join(starts, parent).select(here, (F.col("_start") + F.col("_before")).alias("_start"))
    return numbered.join(starts, "_g1").select(
        (F.col("_start") + F.col("_position")).cast("bigint").alias(key_name), *ids.columns)
