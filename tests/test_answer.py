"""Questions answered over the mart of the test tables."""

import pytest

from tendero.functions import predicates as P
from tendero.operators import pricing, sales, stock, trend
from tendero.operators.tagging import Category, Dictionary, catalog_dictionary
from tendero.plans.answer import REPORTS, answer
from tendero.plans.filters import SalesFilter

DICTIONARY = Dictionary((
    Category("anillos", "PROMO", None, ("anillo", "anillos"), ("red", "blue")),
    Category("tuercas", None, "Brand#2", ("tuerca", "tuercas")),
), suppliers=("supplier#00000000",), branches=("asia", "europe"))

EXPECTED = {
    "los 5 con stock de tuercas": ("stock_by_category", lambda m: stock.stock_by_category(
        m.catalog, SalesFilter(subfamily="Brand#2"), 5)),
    "precio de compra de anillos": ("purchase_prices", lambda m: pricing.purchase_prices(
        m.catalog, m.last_prices, SalesFilter(family="PROMO"), 10)),
    "ranking de tuercas en asia": ("top_sellers", lambda m: sales.top_sellers(
        m.tickets, SalesFilter(subfamily="Brand#2", branches=("asia",)))),
    "cuánto tengo que pedir de anillos": ("how_much_to_order", lambda m: stock.how_much_to_order(
        m.alerts, m.last_prices, SalesFilter(family="PROMO"))),
    "proveedor supplier#00000000": ("restock_by_supplier", lambda m: stock.restock_by_supplier(
        m.alerts, m.last_prices, "supplier#00000000")),
    "qué viene bajando en europe": ("trend_items", lambda m: trend.trend_items(
        m.tickets, m.alerts, "baja", "europe")),
    "comparar precio de tuercas": ("sale_vs_purchase", lambda m: pricing.sale_vs_purchase(
        m.tickets, m.last_prices, SalesFilter(subfamily="Brand#2"))),
}


@pytest.mark.parametrize("question", EXPECTED)
def test_answer(mart, question):
    route, rows = answer(mart, question, DICTIONARY)
    name, expected = EXPECTED[question]
    assert route == name
    assert rows.collect() == expected(mart).collect()


def test_no_report(mart):
    assert answer(mart, "hola", DICTIONARY) == (None, None)


@pytest.mark.parametrize("name", REPORTS)
def test_every_report_runs(mart, name):
    tags = {"text": "x", "top_n": 10, "wants_alert": True}
    flt = SalesFilter(subfamily="Brand#2", supplier="supplier#00000000", branches=("asia",),
                      date_from="2001-01-01", date_to="2001-12-31")
    REPORTS[name](mart, flt, tags, P.last_date(mart.tickets)).collect()


def test_catalogue_as_dictionary(mart):
    dictionary = Dictionary.from_frame(catalog_dictionary(mart.catalog))
    route, rows = answer(mart, "stock de brand#2", dictionary)
    assert route == "stock_by_category" and rows.count() > 0
