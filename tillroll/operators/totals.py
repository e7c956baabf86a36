"""Per-entity totals shared by the rankings, segments and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def resolve_keys(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Replace keys the dimension does not know by NULL, so dangling lines form one group.

    Shuffles every line. A fact whose dangling keys are NULL already, as ``build_fact_sales``
    writes them, or that passed the orphan check, does not need it.
    """
    known = dimension.select(F.col(key).alias("_known_key"))
    others = [c for c in fact.columns if c != key]
    return fact.join(known, F.col(key) == F.col("_known_key"), "left").select(
        F.col("_known_key").alias(key), *others)


def totals_by_dimension(
    fact: DataFrame,
    dimension: DataFrame,
    key: str,
    attributes: list[str],
    **measures: tuple[Callable[[str], Column], str],
) -> DataFrame:
    """Additive fact measures by dimension attributes.

    Lines are summed by key before the join, so it sees one row per key however hot the
    key is; dangling keys then meet in the NULL group. Measures must be sums, minima or
    maxima, given as ``name=(function, column)``.
    """
    by_key = fact.groupBy(key).agg(*[f(c).alias(name) for name, (f, c) in measures.items()])
    looked_up = dimension.select(F.col(key).alias("_known_key"), *[c for c in attributes if c != key])
    joined = by_key.join(looked_up, F.col(key) == F.col("_known_key"), "left")
    groups = [F.col("_known_key").alias(key) if c == key else F.col(c) for c in attributes]
    return joined.groupBy(*groups).agg(*[f(name).alias(name) for name, (f, _) in measures.items()])


def resolve_reduced(pairs: DataFrame, dimension: DataFrame, key: str, second: str, flag: str,
                    **measures: Callable[[str], Column]) -> DataFrame:
    """Rows by (``key``, ``second``) summed to keys the dimension knows, and NULL for all others.

    ``flag`` is 1 for a pair that counts. Known keys add theirs up. Pairs of unknown keys can meet
    in NULL with the same ``second``, so there a row for each ``second`` is left. The lookup sees pairs
    that are reduced already, never lines.
    """
    known = dimension.select(F.col(key).alias("_known_key"))
    unknown = F.col("_known_key").isNull()
    found = pairs.join(known, F.col(key) == F.col("_known_key"), "left")
    summed = found.groupBy(F.col("_known_key").alias(key), F.when(unknown, F.col(second)).alias("_second")).agg(
        F.sum(flag).alias("_all"), F.max(flag).alias("_one"), *[f(name).alias(name) for name, f in measures.items()])
    return summed.select(key, F.when(F.col(key).isNull(), F.col("_one")).otherwise(F.col("_all")).alias(flag), *measures)


def order_totals(
    fact: DataFrame, key: str, other_key: str, others: str, with_price: bool = False, dimension: DataFrame | None = None,
) -> DataFrame:
    """Sales lines by ``key``: sums, first and last date, distinct orders and partners.

    ``others`` names the distinct count of ``other_key``. Two distinct counts in one
    aggregation would send three wide copies of every line through the shuffle. Here each
    count has its own narrow first step, by (key, order) and by (key, partner), and a hot
    key is spread over its orders and partners until only counts are left. ``with_price``
    adds the mean line price (amount / quantity) as ``avg_unit_price``. With a ``dimension``, lines
    whose key it does not know form one group, NULL; they are looked up after the first steps.
    """
    unit_price = F.col("sales_amount") / F.nullif(F.col("quantity"), F.lit(0))
    price_parts = [
        F.sum(unit_price).alias("_price_sum"), F.count(unit_price).alias("_price_count"),
    ] if with_price else []
    per_order = fact.groupBy(key, "order_number").agg(
        F.sum("sales_amount").alias("total_sales"),
        F.sum("quantity").alias("total_quantity"),
        F.min("order_date").alias("first_date"),
        F.max("order_date").alias("last_date"),
        *price_parts,
    ).withColumn("_order", F.col("order_number").isNotNull().cast("int"))
    per_other = fact.select(key, other_key).distinct().withColumn("_other", F.col(other_key).isNotNull().cast("int"))
    if dimension is not None:
        prices = {"_price_sum": F.sum, "_price_count": F.sum} if with_price else {}
        per_order = resolve_reduced(
            per_order, dimension, key, "order_number", "_order",
            total_sales=F.sum, total_quantity=F.sum, first_date=F.min, last_date=F.max, **prices)
        per_other = resolve_reduced(per_other, dimension, key, other_key, "_other")
    per_order, per_other = per_order.drop("order_number"), per_other.select(key, "_other")
    parts = per_order.unionByName(per_other, allowMissingColumns=True)
    mean_price = [
        F.try_divide(F.sum("_price_sum"), F.sum("_price_count").cast("double")).alias("avg_unit_price"),
    ] if with_price else []
    return parts.groupBy(key).agg(
        F.sum("_order").alias("total_orders"),
        F.sum("total_sales").alias("total_sales"),
        F.sum("total_quantity").alias("total_quantity"),
        F.sum("_other").alias(others),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        *mean_price,
    )
