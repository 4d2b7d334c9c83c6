"""The filter a report is asked for, and which of its fields win."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tendero.functions import predicates as P


@dataclass(frozen=True)
class SalesFilter:
    """Item, size, period and branch restrictions of one report.

    The item fields overlap (a brand implies a subfamily, a subfamily a family), so a
    report applies the first field set in its own order of precedence.
    """

    subfamily: str | None = None
    family: str | None = None
    brands: Sequence[str] = ()
    supplier: str | None = None
    size_label: str | None = None
    min_cc: int | None = None
    max_cc: int | None = None
    min_g: int | None = None
    date_from: dt.date | str | None = None
    date_to: dt.date | str | None = None
    branches: Sequence[str] = ()

    def _field(self, name: str, exact_subfamily: bool) -> Column | None:
        if name == "subfamily" and self.subfamily:
            test = P.equals if exact_subfamily else P.by_subfamily
            return test("subfamily", self.subfamily)
        if name == "family" and self.family:
            return P.equals("family", self.family)
        if name == "brands" and self.brands:
            return P.by_brands("description", self.brands)
        if name == "supplier" and self.supplier:
            return P.by_supplier("supplier", self.supplier)
        return None

    def first_of(self, *order: str, exact_subfamily: bool = False) -> Column | None:
        """Predicate of the first field set in the given order, or None."""
        tests = (self._field(name, exact_subfamily) for name in order)
        return next((t for t in tests if t is not None), None)

    def all_of(self, *names: str) -> Column | None:
        """All the fields that are set, together."""
        tests = [t for t in (self._field(name, False) for name in names) if t is not None]
        return reduce(and_, tests) if tests else None

    def sizes(self, *names: str) -> Column | None:
        """Size restrictions that are set, together."""
        built = {
            "size_label": lambda: self.size_label and P.by_size_label("description", self.size_label),
            "min_cc": lambda: self.min_cc and P.by_min_volume("description", self.min_cc),
            "max_cc": lambda: self.max_cc and P.by_max_volume("description", self.max_cc),
            "min_g": lambda: self.min_g and P.by_min_weight("description", self.min_g),
        }
        tests = [t for t in (built[name]() for name in names or built) if isinstance(t, Column)]
        return reduce(and_, tests) if tests else None

    def period(self, tickets: DataFrame) -> Column | None:
        if self.date_from is None and self.date_to is None:
            return None
        return P.in_period(tickets, self.date_from, self.date_to)


def keep(df: DataFrame, *tests: Column | None) -> DataFrame:
    """Rows passing every test given; tests that are None are skipped."""
    present = [t for t in tests if t is not None]
    return df.where(reduce(and_, present)) if present else df


def first(df: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows, or all where ``n`` is None."""
    return df if n is None else df.limit(n)


def nothing(df: DataFrame) -> DataFrame:
    """No rows: the answer of a report that needs a restriction and got none."""
    return df.where(F.lit(False))
