"""KPIs and insight cards over a (filtered) sales frame.

Each insight is a frame of at most one row of plain numbers; ``all_insights`` renders the
cards. An insight that has nothing to say, as on an empty frame, is an empty frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.functions.dates import month_name
from tillroll.functions.numbers import percent, total
from tillroll.functions.text import plain_number
from tillroll.operators.bitmaps import key_bitmaps, key_spans, number_of_keys


# --- KPIs ----------------------------------------------------------------------------------

def kpis_with_lines(sales: DataFrame) -> DataFrame:
    """The headline figures and, as ``lines``, how many sales lines they come from.

    A frame that is summed already says in ``lines`` how many lines each row stands for.
    """
    lines = F.sum("lines") if "lines" in sales.columns else F.count("*")
    # Two distinct counts in one aggregation would send copies of every line. Lines are summed by
    # order and customer first; those rows then count towards both.
    reduced = sales.groupBy("order_number", "customer_key").agg(
        F.sum("sales_amount").alias("_revenue"), F.sum("profit").alias("_profit"),
        F.sum("quantity").alias("_units"), lines.alias("_lines"))
    nothing = F.lit(None)
    sides = F.array(
        F.struct(F.lit(True).alias("_is_order"), F.col("order_number").cast("string").alias("_key"),
                 *[F.col(c) for c in ("_revenue", "_profit", "_units", "_lines")]),
        F.struct(F.lit(False).alias("_is_order"), F.col("customer_key").cast("string").alias("_key"),
                 *[nothing.cast(reduced.schema[c].dataType).alias(c)
                   for c in ("_revenue", "_profit", "_units", "_lines")]))
    by_key = reduced.select(F.inline(sides)).groupBy("_is_order", "_key").agg(
        *[F.sum(c).alias(c) for c in ("_revenue", "_profit", "_units", "_lines")])
    known = F.col("_key").isNotNull()
    return _with_ratios(by_key.agg(
        total(F.col("_revenue")).cast("double").alias("revenue"),
        total(F.col("_profit")).cast("double").alias("profit"),
        F.count_if(F.col("_is_order") & known).alias("orders"),
        F.count_if(~F.col("_is_order") & known).alias("customers"),
        total(F.col("_units")).alias("units"),
        total(F.col("_lines")).alias("lines"),
    ))


def _with_ratios(sums: DataFrame) -> DataFrame:
    """The headline figures in order, from their sums and counts."""
    def per_order(c: str) -> Column:
        return F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("orders").cast("double")), F.lit(0.0))

    return sums.select(
        "revenue",
        "profit",
        F.coalesce(percent(F.col("profit"), F.col("revenue")), F.lit(0.0)).alias("margin"),
        "orders",
        "customers",
        "units",
        per_order("revenue").alias("aov"),
        per_order("units").alias("items_per_order"),
        "lines",
    )


def kpis(sales: DataFrame) -> DataFrame:
    """Top-line figures in one row; ratios without a base are 0."""
    return kpis_with_lines(sales).drop("lines")


def kpis_of(parts: dict[str, DataFrame]) -> DataFrame:
    """`kpis_with_lines` from report parts: sums by product, order numbers and customers as bitmaps.

    No pair of order and customer is formed. ``parts["customers"]`` is any table with the customer keys.
    """
    nothing = {"revenue": "double", "profit": "double", "orders": "bigint", "customers": "bigint",
               "units": "bigint", "lines": "bigint"}

    def side(rows: DataFrame, **found: Column) -> DataFrame:
        return rows.agg(*[
            found[name].cast(kind).alias(name) if name in found else F.lit(0).cast(kind).alias(name)
            for name, kind in nothing.items()])

    sums = side(parts["products"], revenue=total(F.col("sales_amount")), profit=total(F.col("profit")),
                units=total(F.col("quantity")), lines=total(F.col("lines")))
    orders = side(parts["orders"], orders=number_of_keys())
    customers = side(key_bitmaps(parts["customers"], "customer_key"), customers=number_of_keys())
    return _with_ratios(sums.unionByName(orders).unionByName(customers).agg(
        *[F.sum(name).alias(name) for name in nothing]))


def revenue_per_customer(sales: DataFrame) -> DataFrame:
    """Revenue per distinct customer; NULL when there is none."""
    found = key_bitmaps(sales, "customer_key", (), F.sum("sales_amount").alias("_revenue"))
    revenue, customers = total(F.col("_revenue")), number_of_keys()
    return found.agg(
        F.try_divide(revenue.cast("double"), customers.cast("double")).alias("revenue_per_customer"))


# --- insights ------------------------------------------------------------------------------

def _by(sales: DataFrame, key: str, *more: Column) -> DataFrame:
    """Revenue per known key."""
    return sales.where(F.col(key).isNotNull()).groupBy(key).agg(
        total(F.col("sales_amount")).alias("revenue"), *more)


def _first_by(order: Column, *columns: Column) -> Column:
    """Aggregate: the row smallest in ``order``, ties going to the first label."""
    return F.min(F.struct(order.alias("_order"), *columns))


def category_concentration(sales: DataFrame) -> DataFrame:
    """The top category and its share of revenue."""
    found = _by(sales, "category").agg(
        F.sum("revenue").alias("total"),
        _first_by(-F.col("revenue"), F.col("category"), F.col("revenue")).alias("top"))
    return found.where(F.col("total") != 0).select(
        F.col("top.category").alias("category"),
        percent(F.col("top.revenue"), F.col("total")).alias("share_pct"))


def margin_opportunity(sales: DataFrame) -> DataFrame:
    """The category with the richest margin, among those that earn anything."""
    earning = _by(sales, "category", total(F.col("profit")).alias("profit")).where(F.col("revenue") > 0)
    found = earning.withColumn("margin", percent(F.col("profit"), F.col("revenue"))).agg(
        F.sum("revenue").alias("total"),
        F.sum("profit").alias("profit"),
        _first_by(-F.col("margin"), F.col("category"), F.col("revenue"), F.col("margin")).alias("best"))
    return found.where(F.col("total").isNotNull()).select(
        F.col("best.category").alias("category"),
        F.col("best.margin").alias("margin_pct"),
        percent(F.col("profit"), F.col("total")).alias("overall_margin_pct"),
        percent(F.col("best.revenue"), F.col("total")).alias("share_pct"))


def repeat_customer_value(sales: DataFrame) -> DataFrame:
    """Customers with two or more orders: their share of heads and of revenue.

    Revenue without a known customer counts in the base only. Two orders or more is to say that
    the first and the last order number differ, so no pair of customer and order is formed; a frame
    that is summed already has them as ``first`` and ``last``.
    """
    if "first" not in sales.columns:
        sales = key_spans(sales, "order_number", ["customer_key"], F.sum("sales_amount").alias("sales_amount"))
    per_customer = sales.groupBy("customer_key").agg(
        total(F.col("sales_amount")).alias("revenue"),
        F.min("first").alias("_first"), F.max("last").alias("_last"))
    repeat = F.col("customer_key").isNotNull() & (F.col("_first") < F.col("_last"))
    found = per_customer.agg(
        F.sum("revenue").alias("total"),
        F.count("customer_key").alias("customers"),
        F.count_if(repeat).alias("repeat_customers"),
        total(F.when(repeat, F.col("revenue"))).alias("repeat_revenue"))
    return found.where((F.col("total") != 0) & (F.col("customers") > 0)).select(
        percent(F.col("repeat_customers"), F.col("customers")).alias("repeat_customer_pct"),
        percent(F.col("repeat_revenue"), F.col("total")).alias("repeat_revenue_pct"))


def returning_growth(sales: DataFrame) -> DataFrame:
    """The peak year, its revenue and the share returning customers brought."""
    returning = total(F.when(F.col("is_returning"), F.col("sales_amount"))).alias("returning")
    found = _by(sales, "order_year", returning).agg(
        _first_by(-F.col("revenue"), F.col("order_year"), F.col("revenue"), F.col("returning")).alias("peak"))
    return found.where(F.col("peak.revenue") != 0).select(
        F.col("peak.order_year").alias("peak_year"),
        F.col("peak.revenue").alias("peak_revenue"),
        percent(F.col("peak.returning"), F.col("peak.revenue")).alias("returning_share_pct"))


def market_concentration(sales: DataFrame) -> DataFrame:
    """The two strongest countries and their joint share."""
    by_country = _by(sales, "country")
    overall = by_country.agg(F.sum("revenue")).scalar()
    strongest = by_country.orderBy(F.col("revenue").desc(), "country").limit(2)
    found = strongest.agg(
        F.array_sort(F.collect_list(F.struct(-F.col("revenue"), "country"))).alias("pair"),
        F.sum("revenue").alias("revenue"),
    ).withColumn("total", overall)
    return found.where(F.col("total") != 0).select(
        F.array_join(F.col("pair.country"), " + ").alias("countries"),
        percent(F.col("revenue"), F.col("total")).alias("share_pct"))


def seasonality(sales: DataFrame) -> DataFrame:
    """The strongest and weakest calendar month present, and their ratio."""
    by_month = _by(sales.withColumn("month", F.month("order_date")), "month")
    found = by_month.agg(
        _first_by(-F.col("revenue"), F.col("month"), F.col("revenue")).alias("high"),
        _first_by(F.col("revenue"), F.col("month"), F.col("revenue")).alias("low"))
    return found.where(F.col("low.revenue") != 0).select(
        F.col("high.month").alias("strongest_month"),
        F.col("low.month").alias("weakest_month"),
        (F.col("high.revenue").cast("double") / F.col("low.revenue").cast("double")).alias("ratio"))


# --- cards ---------------------------------------------------------------------------------

# The wording of the cards. %s marks a figure or label.
CARD_TEXT = {
    "category_concentration": (
        "🎯", "Revenue concentration",
        "%s%%",
        "**%s** alone accounts for **%s%%** of revenue. The business is heavily reliant on a single category.",
        "Diversify the catalogue and grow the smaller categories to reduce risk.",
    ),
    "margin_opportunity": (
        "💰", "Margin opportunity",
        "%s%% margin",
        "**%s** earns the richest margin (**%s%%** vs %s%% overall) but is only **%s%%** of sales.",
        "Push %s as add-on/attach items — they lift profit far more than their revenue share suggests.",
    ),
    "repeat_customer_value": (
        "🔁", "Repeat customers carry the business",
        "%s%% of revenue",
        "Just **%s%%** of customers buy more than once, yet they generate **%s%%** of revenue.",
        "Invest in retention (loyalty, re-order nudges) over pure acquisition — "
        "a second purchase is where the money is.",
    ),
    "returning_growth": (
        "📈", "Growth came from returning buyers",
        "€%sM peak",
        "Revenue peaked in **%s** (€%sM), and **%s%%** of that came from *returning* customers — "
        "the repeat-purchase flywheel kicking in.",
        "Protect the flywheel: keep first-time buyers engaged so they return.",
    ),
    "market_concentration": (
        "🌍", "Two markets dominate",
        "%s%%",
        "**%s** together make up **%s%%** of revenue.",
        "Defend the core two markets while testing growth in the long tail (UK, Germany, France).",
    ),
    "seasonality": (
        "📅", "Clear seasonal peak",
        "%s× swing",
        "**%s** is the strongest month and **%s** the weakest — a **%s×** swing.",
        "Build inventory and marketing toward %s; run promotions to lift the %s trough.",
    ),
}


def _card(position: int, name: str, found: DataFrame, metric: tuple, takeaway: tuple, action: tuple = ()) -> DataFrame:
    icon, title, *wording = CARD_TEXT[name]
    metric, takeaway, action = (
        F.format_string(text, *figures) if figures else F.lit(text)
        for text, figures in zip(wording, (metric, takeaway, action)))
    return found.select(
        F.lit(position).alias("position"), F.lit(name).alias("id"), F.lit(icon).alias("icon"),
        F.lit(title).alias("title"), metric.alias("metric"), takeaway.alias("takeaway"),
        action.alias("action"))


def _figure(name: str, places: int = 0) -> Column:
    return plain_number(F.col(name), places)


def report_parts(sales: DataFrame) -> dict[str, DataFrame]:
    """The frame summed to the tables that the cards and the snapshot read instead of the lines.

    ``products`` has a row per product and category, ``customers`` one per customer, month and
    labels with the first and last order, ``orders`` the order numbers as bitmaps. The first
    two keep the frame's column names, so what adds up sales reads them as it reads the frame; labels
    the frame lacks are left out. Store the parts, not the frame: each reads the frame once. Where
    the star tables are at hand, `plans.star_parts` makes the same parts without a frame.
    """
    known = set(sales.columns)

    sums = [F.sum(c).alias(c) for c in ("sales_amount", "profit", "quantity") if c in known]
    sums.append(F.count("*").alias("lines"))
    month = [F.trunc("order_date", "MM").alias("order_date")] if "order_date" in known else []
    by_customer = ("customer_key", "country", "customer_segment", "order_year", "is_returning")
    return {
        "products": sales.groupBy(*[c for c in ("product_name", "category") if c in known]).agg(*sums),
        "customers": key_spans(sales, "order_number", [c for c in by_customer if c in known] + month, *sums),
        "orders": key_bitmaps(sales, "order_number"),
    }


def all_insights(sales: DataFrame) -> DataFrame:
    """The rendered cards in display order."""
    return cards_of(report_parts(sales))


def cards_of(parts: dict[str, DataFrame]) -> DataFrame:
    """The rendered cards from the report parts of a frame or of star tables."""
    products, customers = parts["products"], parts["customers"]
    share, margin = _figure("share_pct", 1), _figure("margin_pct")
    millions = plain_number(F.col("peak_revenue") / 1e6, 1)
    repeat = _figure("repeat_revenue_pct")
    swing = _figure("ratio", 1)
    high, low = month_name(F.col("strongest_month")), month_name(F.col("weakest_month"))
    cards = [
        _card(1, "category_concentration", category_concentration(products),
              (share,), (F.col("category"), share)),
        _card(2, "margin_opportunity", margin_opportunity(products),
              (margin,), (F.col("category"), margin, _figure("overall_margin_pct"), share),
              (F.lower("category"),)),
        _card(3, "repeat_customer_value", repeat_customer_value(customers),
              (repeat,), (_figure("repeat_customer_pct"), repeat)),
        _card(4, "returning_growth", returning_growth(customers),
              (millions,), (F.col("peak_year").cast("string"), millions, _figure("returning_share_pct"))),
        _card(5, "market_concentration", market_concentration(customers),
              (_figure("share_pct"),), (F.col("countries"), _figure("share_pct"))),
        _card(6, "seasonality", seasonality(customers), (swing,), (high, low, swing), (high, low)),
    ]
    out = cards[0]
    for card in cards[1:]:
        out = out.unionByName(card)
    return out.orderBy("position")
