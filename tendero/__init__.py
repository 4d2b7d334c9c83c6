"""Retail analytics on Spark: DataFrame operators over tickets, stock alerts,
purchase prices and the item catalogue."""

from tendero.plans.filters import SalesFilter
from tendero.sources.mart import Mart, load_mart, run_select, write_mart

__all__ = ["Mart", "SalesFilter", "load_mart", "run_select", "write_mart"]
