"""One question in, the rows of its report out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row

from tendero import constants as K
from tendero.functions import predicates as P
from tendero.functions.text import fold_word
from tendero.operators import pricing, sales, stock, trend
from tendero.operators.routing import all_routes
from tendero.operators.tagging import Dictionary, tag_texts
from tendero.plans.filters import SalesFilter
from tendero.sources.mart import Mart

# fixed values: words that ask for falling items
FALLING = ("tendencia baja", "bajando", "en baja", "cayendo")


def filter_of(tags: Row) -> SalesFilter:
    """The restrictions a tagged question names."""
    return SalesFilter(
        subfamily=tags["subfamily"], family=tags["family"], brands=tuple(tags["brands"]),
        supplier=tags["supplier"], size_label=tags["size_label"], min_cc=tags["min_cc"],
        max_cc=tags["max_cc"], min_g=tags["min_g"], date_from=tags["date_from"],
        date_to=tags["date_to"], branches=tuple(tags["branches"]),
    )


def _trend(m: Mart, f: SalesFilter, tags: Row, day: Column) -> DataFrame:
    text = fold_word(tags["text"])
    wanted = K.TREND_DOWN if any(word in text for word in FALLING) else K.TREND_UP
    return trend.trend_items(m.tickets, m.alerts, wanted, f.branches[0] if f.branches else None, as_of=day)


def _leaders(m: Mart, f: SalesFilter, tags: Row, day: Column) -> DataFrame:
    period = (f.date_from, f.date_to) if f.date_from or f.date_to else None
    return sales.family_margin_leaders(m.tickets, period, as_of=day)


REPORTS: dict[str, Callable[[Mart, SalesFilter, Row, Column], DataFrame]] = {
    "below_cost": lambda m, f, t, day: pricing.below_cost(m.alerts, f),
    "lost_sales_value": lambda m, f, t, day: stock.lost_sales_value(m.alerts, f),
    "sales_by_branch": lambda m, f, t, day: sales.sales_by_branch(m.tickets, f),
    "restock_by_supplier": lambda m, f, t, day: stock.restock_by_supplier(m.alerts, m.last_prices, f.supplier),
    "how_much_to_order": lambda m, f, t, day: stock.how_much_to_order(m.alerts, m.last_prices, f),
    "offer_candidates": lambda m, f, t, day: stock.offer_candidates(m.alerts, f),
    "trend_items": _trend,
    "before_after_event": lambda m, f, t, day: sales.before_after_event(
        m.tickets, as_of=day),
    "budget_by_supplier": lambda m, f, t, day: stock.budget_by_supplier(m.alerts, f),
    "excess_for_transfer": lambda m, f, t, day: stock.excess_for_transfer(m.alerts, f),
    "family_margin_leaders": _leaders,
    "high_sales_low_margin": lambda m, f, t, day: pricing.high_sales_low_margin(m.tickets, m.last_prices, f),
    "critical_with_sales": lambda m, f, t, day: stock.critical_with_sales(
        m.alerts, m.tickets, f, day),
    "sale_vs_purchase": lambda m, f, t, day: pricing.sale_vs_purchase(m.tickets, m.last_prices, f, t["top_n"]),
    "top_sellers_with_cost": lambda m, f, t, day: pricing.top_sellers_with_cost(
        m.tickets, m.last_prices, f, t["top_n"]),
    "purchase_prices": lambda m, f, t, day: pricing.purchase_prices(m.catalog, m.last_prices, f, t["top_n"]),
    "bestsellers_at_risk": lambda m, f, t, day: stock.bestsellers_at_risk(m.alerts, f, t["wants_alert"]),
    "stock_by_category": lambda m, f, t, day: stock.stock_by_category(m.catalog, f, t["top_n"]),
    "top_sellers": lambda m, f, t, day: sales.top_sellers(m.tickets, f, t["top_n"]),
}


def answer(
    mart: Mart, question: str, dictionary: Dictionary, as_of: P.DateLike | None = None,
) -> tuple[str | None, DataFrame | None]:
    """Name and rows of the report a question asks for; (None, None) if it asks for none.

    The question is tagged by the expressions used for whole tables, as a table of one row. Where
    a report has no rows, the next rule that holds is tried; if all are empty, the first is returned.
    """
    day = P.resolve_as_of(mart.tickets, as_of or mart.newest)
    one = mart.tickets.sparkSession.createDataFrame([(question,)], "text string")
    tags = all_routes(tag_texts(one, "text", dictionary, day), "text").first()
    reports = [(name, REPORTS[name](mart, filter_of(tags), tags, day)) for name in tags["routes"]]
    if not reports:
        return None, None
    return next((report for report in reports if not report[1].isEmpty()), reports[0])
