"""Day totals of each branch with the set of items sold, as bitmaps that add up exactly.

Counts of distinct items do not add up over days and branches, sets of them do. A day's set is one bitmap for each run of
32,768 item numbers, so a report over any days and branches unites some bitmaps and counts their bits, without
looking at lines or moving items. Bitmaps take 4 KB before compression: item numbers should be dense,
as those of a catalog are; sparse ones give right counts from more rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tendero.functions import measures as M, predicates as P
from tendero.plans.filters import keep

SUMS = ("price_total", "cost_total", "quantity", "profit")
DAY = ("branch", "sale_date", "bucket")


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in SUMS]


def day_sales(rows: DataFrame) -> DataFrame:
    """``branch, sale_date, bucket, items`` and sums, of sale lines or of tables that this function made.

    A task makes one bitmap for each group it meets, so groups move and not their items. Lines without item count
    in the sums; their bucket is null and its bitmap empty.
    """
    if "items" in rows.columns:
        return rows.groupBy(*DAY).agg(F.bitmap_or_agg("items").alias("items"), *_sums())
    lines = rows.withColumn("profit", M.profit()).withColumn("bucket", F.bitmap_bucket_number("item_id"))
    return lines.groupBy(*DAY).agg(F.bitmap_construct_agg(F.bitmap_bit_position("item_id")).alias("items"), *_sums())


def _totals(sold: DataFrame, by: Sequence[str]) -> DataFrame:
    """Figures of each group; the bitmaps of a bucket are united first, in every task before they move."""
    united = sold.groupBy(*by, "bucket").agg(F.bitmap_or_agg("items").alias("items"), *_sums())
    return united.groupBy(*by).agg(
        M.in_millions(F.sum("price_total"), 2).alias("sales_m"),
        M.in_millions(F.sum("profit"), 2).alias("profit_m"),
        M.total("quantity", 0).alias("units"),
        M.margin_of_sums().alias("margin_pct"),
        F.sum(F.bitmap_count("items")).alias("items"),
    )


def branch_totals(
    sold: DataFrame, date_from: P.DateLike | None = None, date_to: P.DateLike | None = None,
) -> DataFrame:
    """What ``sales.sales_by_branch`` gives for a period, from day totals."""
    rows = keep(sold, P.in_period(sold, date_from, date_to))
    return _totals(rows, ["branch"]).orderBy(F.desc("sales_m"), "branch")


def month_totals(
    sold: DataFrame, branches: Sequence[str] | None = None,
    date_from: P.DateLike | None = None, date_to: P.DateLike | None = None,
) -> DataFrame:
    """Sales, profit, units, margin and distinct items of each month over some branches (all if none are named)."""
    asked = P.by_branches("branch", branches) if branches else None
    rows = keep(sold, asked, P.in_period(sold, date_from, date_to))
    return _totals(rows.withColumn("month", F.trunc("sale_date", "month").cast("date")), ["month"]).orderBy("month")
