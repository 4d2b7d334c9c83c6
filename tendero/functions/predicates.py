"""Row predicates. Each takes a column and plain Python values and returns a
boolean column that Catalyst can push towards the scan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from tendero import constants as K
from tendero.functions.text import fold_word

DateLike = dt.date | str | Column


def as_col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def as_date(value: DateLike) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


# ---- text ------------------------------------------------------------------

def text_contains(column: str | Column, text: str) -> Column:
    """Case-insensitive substring test."""
    return F.lower(as_col(column)).contains(text.lower())


def contains_any(column: str | Column, texts: Iterable[str]) -> Column:
    """Case-insensitive test for any of the substrings."""
    return reduce(or_, [text_contains(column, t) for t in texts])


def by_subfamily(column: str | Column, subfamily: str) -> Column:
    return text_contains(column, subfamily)


def equals(column: str | Column, value: str) -> Column:
    """Exact, case-sensitive match (family, subfamily or branch by full name)."""
    return as_col(column) == value


def by_brands(column: str | Column, brands: Sequence[str]) -> Column:
    return contains_any(column, brands)


def by_supplier(column: str | Column, name: str) -> Column:
    """Supplier name contains, ignoring case, padding and accents of the name asked for."""
    return F.lower(F.trim(as_col(column))).contains(fold_word(name))


# ---- branches --------------------------------------------------------------

def by_branches(column: str | Column, branches: Sequence[str]) -> Column:
    return F.lower(as_col(column)).isin([b.lower() for b in branches])


def in_branches_exact(column: str | Column, branches: Sequence[str]) -> Column:
    return as_col(column).isin(list(branches))


# ---- dates -----------------------------------------------------------------

def last_date(tickets: DataFrame) -> Column:
    """Date of the newest sale line of these rows, as a scalar subquery. A mart knows that of all its lines: ``Mart.newest``."""
    return tickets.agg(F.max("sale_date")).scalar()


def resolve_as_of(tickets: DataFrame, as_of: DateLike | None) -> Column:
    """The day a report is for: the one given, else the newest sale date."""
    return last_date(tickets) if as_of is None else as_date(as_of)


def in_period(tickets: DataFrame, start: DateLike | None, end: DateLike | None = None) -> Column:
    """Inclusive date range on ``sale_date``.

    When the table is laid out by month the same bounds are also put on the
    partition column, so whole months are skipped before any file is opened.
    """
    tests = []
    if start is not None:
        lo = as_date(start)
        tests.append(F.col("sale_date") >= lo)
        if "sale_month" in tickets.columns:
            tests.append(F.col("sale_month") >= F.trunc(lo, "month").cast("date"))
    if end is not None:
        hi = as_date(end)
        tests.append(F.col("sale_date") <= hi)
        if "sale_month" in tickets.columns:
            tests.append(F.col("sale_month") <= F.trunc(hi, "month").cast("date"))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def last_days(tickets: DataFrame, days: int, as_of: DateLike | None = None) -> Column:
    """The last ``days`` calendar dates up to and including the report day."""
    end = resolve_as_of(tickets, as_of)
    return in_period(tickets, F.date_sub(end, days - 1), end)


def month_start(day: Column) -> Column:
    return F.trunc(day, "month").cast("date")


def in_month(tickets: DataFrame, month: DateLike) -> Column:
    """Rows of the calendar month holding the given day, as a date range."""
    first = month_start(as_date(month))
    return in_period(tickets, first, F.last_day(first))


def in_years(tickets: DataFrame, years: Sequence[int]) -> Column:
    """Rows of the listed calendar years.

    Written as one range per year, so each can skip months and row groups.
    """
    return reduce(or_, [in_period(tickets, dt.date(y, 1, 1), dt.date(y, 12, 31)) for y in years])


# ---- pack sizes ------------------------------------------------------------

def by_size_label(column: str | Column, label: str) -> Column:
    """Description carries the size label in any of its usual spellings."""
    return contains_any(column, K.SIZE_SPELLINGS.get(label, (label,)))


def _by_labels(column: str | Column, sizes: dict[int, tuple[str, ...]], wanted, fallback: str) -> Column:
    labels = [label for size, spelled in sizes.items() if wanted(size) for label in spelled]
    return contains_any(column, labels or (fallback,))


def by_min_volume(column: str | Column, cc: int) -> Column:
    return _by_labels(column, K.LARGE_VOLUME_LABELS, lambda size: size >= cc, str(cc))


def by_max_volume(column: str | Column, cc: int) -> Column:
    return _by_labels(column, K.SMALL_VOLUME_LABELS, lambda size: size < cc, str(cc))


def by_min_weight(column: str | Column, grams: int) -> Column:
    return _by_labels(column, K.LARGE_WEIGHT_LABELS, lambda size: size >= grams, f"{grams}g")


# fixed values: spellings of pack units and what they hold in cc or grams
VOLUME = {"cc": 1, "ml": 1, "lts": 1000, "lt": 1000, "l": 1000, "litros": 1000, "litro": 1000}
WEIGHT = {"grs": 1, "gr": 1, "g": 1, "kgs": 1000, "kg": 1000}


def pack_amount(column: str | Column, units: dict[str, int]) -> Column:
    """Pack size read from a description, in the base unit; null where none is named.

    The first number followed by one of the units counts, with point or comma: ``x750cc``, ``1,5 l``.
    """
    text = F.lower(as_col(column))
    pattern = rf"(\d+(?:[.,]\d+)?)\s*({'|'.join(units)})(?![a-z])"
    number, unit = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    factor = F.coalesce(*[F.when(unit == name, F.lit(float(size))) for name, size in units.items()])
    return F.when(number != "", F.replace(number, F.lit(","), F.lit(".")).try_cast("double") * factor)


def volume_at_least(column: str | Column, cc: float) -> Column:
    return F.coalesce(pack_amount(column, VOLUME) >= cc, F.lit(False))


def volume_below(column: str | Column, cc: float) -> Column:
    return F.coalesce(pack_amount(column, VOLUME) < cc, F.lit(False))


def weight_at_least(column: str | Column, grams: float) -> Column:
    return F.coalesce(pack_amount(column, WEIGHT) >= grams, F.lit(False))


# ---- stock and price -------------------------------------------------------

def needs_restock() -> Column:
    return F.col("restock_alert") == K.RESTOCK_YES


def cover_between(low: int | None, high: int | None) -> Column:
    cover = F.col("days_cover")
    if low is None:
        return cover <= high
    if high is None:
        return cover >= low
    return cover.between(low, high)


def positive(column: str | Column) -> Column:
    return as_col(column) > 0


def is_below_cost() -> Column:
    return F.col("below_cost")


def markup_above(price: str | Column, cost: str | Column, threshold: float) -> Column:
    p, c = as_col(price), as_col(cost)
    return (p > c) & (F.try_divide(p - c, c) > F.lit(float(threshold)))


def present(column: str | Column) -> Column:
    return as_col(column).isNotNull()
