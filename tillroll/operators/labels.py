"""Segment, age, cost and performance labels. Thresholds are defaults, not constants."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Labels and limits of the business rules.
VIP, REGULAR, NEW = "VIP", "Regular", "New"
SEGMENT_MONTHS = 12
SEGMENT_SPEND = 5000
AGE_GROUPS = ((20, "Under 20"), (30, "20-29"), (40, "30-39"), (50, "40-49"))
OLDEST_GROUP = "50 and above"
COST_BANDS = ("Below 100", "100-500", "500-1000", "Above 1000")
COST_LIMITS = (100, 500, 1000)
PRODUCT_SEGMENTS = ("High-Performer", "Mid-Range", "Low-Performer")
PRODUCT_LIMITS = (50000, 10000)


def customer_segment(
    lifespan: Column, spend: Column, months: int = SEGMENT_MONTHS, limit: int = SEGMENT_SPEND
) -> Column:
    """VIP or Regular after enough months, by spend; New otherwise, unknowns included."""
    settled = lifespan >= months
    return F.when(settled & (spend > limit), VIP).when(settled & (spend <= limit), REGULAR).otherwise(NEW)


def age_group(age: Column) -> Column:
    """Age band; an unknown age falls into the last one."""
    bands = F.coalesce(*[F.when(age < below, label) for below, label in AGE_GROUPS])
    return F.coalesce(bands, F.lit(OLDEST_GROUP))


def catalogue_cost_band(cost: Column, limits: tuple = COST_LIMITS) -> Column:
    """Left-closed first band, then inclusive ranges; unknown cost lands in the last band."""
    low, mid, high = limits
    return (
        F.when(cost < low, COST_BANDS[0]).when(cost <= mid, COST_BANDS[1])
        .when(cost <= high, COST_BANDS[2]).otherwise(COST_BANDS[3])
    )


def sold_cost_band(cost: Column, limits: tuple = COST_LIMITS) -> Column:
    """Right-closed bands above -1; unknown cost has none."""
    low, mid, high = limits
    return (
        F.when(cost <= -1, F.lit(None)).when(cost <= low, COST_BANDS[0]).when(cost <= mid, COST_BANDS[1])
        .when(cost <= high, COST_BANDS[2]).when(cost > high, COST_BANDS[3])
    )


def product_segment(sales: Column, limits: tuple = PRODUCT_LIMITS) -> Column:
    high, mid = limits
    top, middle, bottom = PRODUCT_SEGMENTS
    return F.when(sales > high, top).when(sales >= mid, middle).otherwise(bottom)
