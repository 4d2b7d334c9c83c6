"""Numeric building blocks used by the aggregates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MILLION = 1e6


def fixed(value: Column, places: int) -> Column:
    """Round half up after dropping the noise of floating-point addition.

    A sum of doubles depends on the order in which partitions finish. Rounding to
    six places first makes the reported figure, and any ranking on it, the same
    after a lost executor or with another number of partitions.
    """
    return F.round(F.round(value, 6), places)


def total(column: str | Column, places: int) -> Column:
    return fixed(F.sum(column), places)


def in_millions(value: Column, places: int) -> Column:
    return fixed(value / F.lit(MILLION), places)


def profit() -> Column:
    """Profit of one sale line."""
    return F.col("price_total") - F.col("cost_total")


def margin_of_sums(places: int = 1) -> Column:
    """Margin percent weighted by sales: (sum price - sum cost) / sum price."""
    price, cost = F.sum("price_total"), F.sum("cost_total")
    return fixed(F.try_divide(price - cost, price) * 100.0, places)


def mean_margin(places: int = 1) -> Column:
    """Unweighted mean of the margin ratio of the lines, in percent."""
    return fixed(F.avg("margin_ratio") * 100.0, places)


def markup_pct(price: Column, cost: Column, places: int) -> Column:
    """Markup of price over cost in percent; null where the cost is zero."""
    return fixed(F.try_divide(price - cost, cost) * 100.0, places)


def change_pct(current: Column, previous: Column, places: int = 1) -> Column:
    """Percent change; a zero base counts as one, a missing base stays missing."""
    base = F.when(previous == 0, F.lit(1.0)).otherwise(previous)
    return fixed((current - base) / base * 100.0, places)


def line_place() -> Column:
    """One number of fixed width that grows the later a sale line counts.

    Later days come first, then smaller order numbers, then smaller line numbers; an order's line number names one line. As a
    number it lets sums and the latest line share one hash aggregation.
    """
    whole = lambda value: F.lit(str(value)).cast("decimal(38,0)")
    return (F.unix_date("sale_date").cast("decimal(38,0)") * whole(10**26)
            + (whole(10**19) - F.col("order_id")) * whole(10**6) - F.col("line_no")).cast("decimal(38,0)")
