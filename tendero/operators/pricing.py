"""Purchase prices, sale prices and the margin between them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tendero import constants as K
from tendero.functions import measures as M, predicates as P
from tendero.plans.filters import SalesFilter, first, keep, nothing

# Several lines of an item can fall on its last day. These columns, as far as the table
# has them, decide which of them counts as the latest.
TIE_BREAKERS = ("item_key", "order_id", "line_no", "price_unit")


def newest_first(tickets: DataFrame) -> list[Column]:
    ties = [F.col(c).asc_nulls_last() for c in TIE_BREAKERS if c in tickets.columns]
    return [F.desc("sale_date"), *ties]


#: What tells the lines of a mart apart, where it has both.
NUMBERED = ("order_id", "line_no")
#: What the latest line of an item is asked by and for.
LATEST = ("sale_date", "order_id", "line_no", "price_unit")


def latest_state(tickets: DataFrame) -> DataFrame:
    """The latest line with a price of each item, description and subfamily, by one hash aggregation.

    It can stand for the lines in every report on latest prices, whatever items that asks for, and the state of several
    tables of lines is the state of their states.
    """
    priced = tickets.where(P.positive("price_unit")).withColumn("place", M.line_place())
    return priced.groupBy("item_key", "description", "subfamily").agg(*[F.max_by(c, "place").alias(c) for c in LATEST])


def latest_lines(tickets: DataFrame, key: str) -> DataFrame:
    """The latest sale line of each key.

    Spark keeps one row per key and task before the shuffle, so a key with very many
    lines costs the reducers no more than any other. A hash aggregation by :func:`~tendero.functions.measures.line_place` needs no
    sort but took half as long again: the numbers cost more than sorting a task's lines does.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*newest_first(tickets)))
    return tickets.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def _price_columns() -> list[Column]:
    return [
        M.fixed(F.col("last_cost"), 2).alias("last_cost"),
        F.trim("po_supplier").alias("po_supplier"),
        F.col("last_po_date").cast("date").alias("last_po_date"),
    ]


def _catalog_prices(catalog: DataFrame, prices: DataFrame) -> DataFrame:
    priced = keep(prices, P.present("last_cost"))
    return catalog.join(priced, "item_key").select(
        "item_key", F.trim("description").alias("description"), "family", "subfamily",
        F.trim("supplier").alias("supplier"), F.col("last_cost").alias("_cost"),
        *_price_columns(), F.col("stk_total").alias("stk_total"),
    )


def purchase_prices(
    catalog: DataFrame, prices: DataFrame, flt: SalesFilter, n: int | None = 10,
) -> DataFrame:
    """Dearest purchase prices of the items asked for; needs at least one restriction."""
    if flt.subfamily or not flt.brands:
        item = flt.first_of("subfamily", "family")
    else:
        item = flt.first_of("brands")
    size = flt.sizes("size_label", "min_cc", "max_cc")
    chosen = keep(catalog, item, size) if item is not None or size is not None else nothing(catalog)
    return (
        _catalog_prices(chosen, prices)
        .orderBy(F.desc("_cost"), "item_key").transform(first, n).drop("_cost", "item_key")
    )


def purchase_prices_by_size(
    catalog: DataFrame, prices: DataFrame, text: str, sizes: Sequence[str],
) -> DataFrame:
    """Every item holding a text and one of the sizes, with its purchase price."""
    any_size = reduce(or_, [P.by_size_label("description", s) for s in sizes])
    chosen = keep(catalog, P.text_contains("description", text), any_size)
    return (
        _catalog_prices(chosen, prices)
        .orderBy(F.desc("last_cost"), "item_key")
        .select("description", "supplier", "last_cost", "po_supplier", "last_po_date")
    )


def top_sellers_with_cost(
    tickets: DataFrame, prices: DataFrame, flt: SalesFilter = SalesFilter(), n: int | None = 10,
    since: dt.date | str = K.DEFAULT_SINCE,
) -> DataFrame:
    """Best sellers by units with their latest purchase price.

    The list is cut to ``n`` before prices are looked up. It is not used to thin out the price
    table first: that would add up the sale lines a second time.
    """
    period = flt.period(tickets)
    rows = keep(
        tickets, flt.first_of("subfamily", "brands"), flt.sizes("size_label", "min_cc"),
        P.in_period(tickets, since) if period is None else period,
        P.by_branches("branch", flt.branches) if flt.branches else None,
    )
    best = (
        rows.groupBy("item_key", "description")
        .agg(
            M.total("quantity", 0).alias("units"),
            M.total("price_total", 2).alias("sales"),
            M.mean_margin().alias("margin_pct"),
        )
        .orderBy(F.desc("units"), "item_key", "description").transform(first, n)
    )
    return (
        best.join(prices, "item_key", "left")
        .orderBy(F.desc("units"), "item_key", "description")
        .select("description", "units", "sales", "margin_pct", *_price_columns())
    )


def sale_vs_purchase(
    tickets: DataFrame, prices: DataFrame, flt: SalesFilter = SalesFilter(), n: int | None = 10,
) -> DataFrame:
    """Latest sale price of each item against its latest purchase price, lowest margin first.

    ``n=None`` returns every item.
    """
    rows = keep(
        tickets, flt.first_of("subfamily", "brands", exact_subfamily=True),
        flt.sizes("size_label"), P.positive("price_unit"),
    )
    price = M.fixed(F.col("price_unit"), 2)
    report = (
        latest_lines(rows, "description")
        .join(prices, "item_key")
        .select(
            "description",
            price.alias("last_sale_price"),
            F.col("sale_date").alias("last_sale_date"),
            M.markup_pct(price, F.col("last_cost"), 2).alias("real_margin_pct"),
            *_price_columns(),
        )
        .orderBy(F.asc_nulls_last("real_margin_pct"), "description")
    )
    return first(report, n)


def last_sale_price(tickets: DataFrame, flt: SalesFilter = SalesFilter()) -> DataFrame:
    """Latest sale price of every item, by description."""
    rows = keep(tickets, flt.first_of("subfamily", "brands", exact_subfamily=True), P.positive("price_unit"))
    return latest_lines(rows, "description").select(
        "description", F.col("sale_date").alias("last_date"),
        M.fixed(F.col("price_unit"), 2).alias("last_sale_price"),
    ).orderBy("description")


def high_sales_low_margin(
    tickets: DataFrame, prices: DataFrame, flt: SalesFilter = SalesFilter(), n: int | None = 15,
    max_margin: float | None = None,
) -> DataFrame:
    """Items that bring most sales, with their real margin; optionally only thin margins.

    Totals cover every line; the latest price only the lines asked for. One pass over the lines gives
    both per item and description; the latest line of an item is then chosen among those few rows.
    """
    wanted = flt.first_of("subfamily", "brands", exact_subfamily=True)
    asked = P.positive("price_unit") if wanted is None else P.positive("price_unit") & wanted
    totals = [M.total("price_total", 2).alias("sales_total"), M.total("quantity", 0).alias("units")]
    item = Window.partitionBy("item_key")
    if set(NUMBERED) <= set(tickets.columns):
        place = F.when(asked, M.line_place())
        line, latest = [F.max(place).alias("line"), F.max_by("price_unit", place).alias("price")], F.max(F.struct("line", "price")).over(item)["price"]
    else:
        ties = [F.col(c) for c in TIE_BREAKERS if c in tickets.columns]
        # the smallest struct is the latest line: days count down, ties go up with nulls last
        line = F.struct((-F.unix_date("sale_date")).alias("day"), *[x for t in ties for x in (t.isNull(), t)], F.col("price_unit").alias("price"))
        line, latest = [F.min(F.when(asked, line)).alias("line")], F.min("line").over(item)["price"]
    totals = tickets.groupBy("item_key", "description").agg(*totals, *line)
    totals = totals.withColumn("last_sale_price", M.fixed(latest, 2)).where("last_sale_price IS NOT NULL")
    report = (
        totals.join(keep(prices, P.positive("last_cost")).select("item_key", "last_cost"), "item_key")
        .select(
            "item_key", "description", "sales_total", "units", "last_sale_price",
            M.fixed(F.col("last_cost"), 2).alias("last_cost"),
            M.markup_pct(F.col("last_sale_price"), F.col("last_cost"), 1).alias("real_margin_pct"),
        )
    )
    if max_margin is not None:
        report = report.where(F.col("real_margin_pct") <= max_margin)
    return report.orderBy(F.desc("sales_total"), "item_key", "description").transform(first, n).drop("item_key")


def below_cost(alerts: DataFrame, flt: SalesFilter = SalesFilter(), n: int | None = 15) -> DataFrame:
    """Items sold below their current cost, most sold first."""
    rows = keep(alerts, P.is_below_cost(), flt.first_of("supplier", "subfamily", "family", "brands"))
    return (
        rows.orderBy(F.desc("units_90d"), "item_key").transform(first, n)
        .select(
            "description", "family", "subfamily", F.trim("supplier").alias("supplier"),
            M.fixed(F.col("price_now"), 2).alias("price_now"),
            M.fixed(F.col("cost_unit"), 2).alias("cost_unit"),
            M.markup_pct(F.col("price_now"), F.col("cost_unit"), 1).alias("margin_pct"),
            "units_90d",
        )
    )
