"""Direction of sales per item and branch, and how urgent a reorder is."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tendero import constants as K
from tendero.functions import labels as L, measures as M, predicates as P
from tendero.plans.filters import first, keep


def weekly_trend(
    tickets: DataFrame, days: int = 7, as_of: P.DateLike | None = None, branch: str | None = None,
) -> DataFrame:
    """Slope of daily units per item and branch over the last days, as a class.

    Lines are added up per day first, so a busy item reaches the second grouping with at
    most one row per day. The slope does not depend on where day zero lies, so the
    calendar day number serves. Slopes are rounded far below the threshold before they are
    compared: the class must not hang on the last bit of a sum.
    """
    rows = keep(tickets, P.last_days(tickets, days, as_of),
                None if branch is None else P.equals("branch", branch))
    daily = rows.groupBy("item_id", "branch", "sale_date").agg(F.sum("quantity").alias("units"))
    per_item = daily.groupBy("item_id", "branch").agg(
        F.count(F.lit(1)).alias("points"),
        F.sum("units").alias("units"),
        F.avg("units").alias("mean_daily"),
        F.round(F.regr_slope("units", F.unix_date("sale_date")), 9).alias("slope"),
    )
    return per_item.withColumn("trend", L.trend_class(F.col("points"), F.col("slope")))


# ---- trends from kept sums -----------------------------------------------------

#: Sums that a slope is made of; those of two sets of days without a common day add up.
MOMENTS = ("n", "sx", "sxx", "sy", "sxy")


@dataclass(frozen=True)
class Rollup:
    """What trends over any window can be added up from.

    ``daily`` has the units of each item, branch and day, ``months`` the moments of each item, branch and month. Blocks of a month are
    valid up to the month of ``open_from``, where it is given: from there on lines came later than the blocks.
    """

    daily: DataFrame
    months: DataFrame | None = None
    open_from: dt.date | None = None


def daily_units(tickets: DataFrame) -> DataFrame:
    """Units of each item, branch and day. The daily units of several tables of lines are their sum."""
    return tickets.groupBy("item_id", "branch", "sale_date").agg(F.sum("quantity").alias("quantity"))


def _moments(x: Column, y: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy")]


def month_moments(daily: DataFrame) -> DataFrame:
    """Moments of the daily units over the days of each month, days counted from its first."""
    month = F.trunc("sale_date", "month").cast("date")
    x = (F.dayofmonth("sale_date") - 1).cast("long")
    return daily_units(daily).where("sale_date IS NOT NULL").groupBy("item_id", "branch", month.alias("month")).agg(*_moments(x, F.col("quantity")))


def window_trend(rollup: Rollup, start: dt.date, end: dt.date, branch: str | None = None) -> DataFrame:
    """What :func:`weekly_trend` gives for the days from ``start`` to ``end``, from a rollup.

    Months that lie whole in the window are one row each, only the days at its ends are added up by day. All
    days are counted from ``start``, so the sums are those of small whole numbers.
    """
    asked = None if branch is None else P.equals("branch", branch)
    first_whole = start if start.day == 1 else (start.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
    after = (end + dt.timedelta(days=1)).replace(day=1)
    if rollup.open_from is not None:
        after = min(after, rollup.open_from.replace(day=1))
    by_day = F.col("sale_date").between(F.lit(start), F.lit(end))
    parts = []
    if rollup.months is not None and first_whole < after:
        by_day &= ~((F.col("sale_date") >= F.lit(first_whole)) & (F.col("sale_date") < F.lit(after)))
        blocks = keep(rollup.months, asked, (F.col("month") >= F.lit(first_whole)) & (F.col("month") < F.lit(after)))
        shift = F.datediff("month", F.lit(start)).cast("long")
        parts.append(blocks.select("item_id", "branch", "n", (F.col("sx") + shift * F.col("n")).alias("sx"),
                                   (F.col("sxx") + 2 * shift * F.col("sx") + shift * shift * F.col("n")).alias("sxx"),
                                   "sy", (F.col("sxy") + shift * F.col("sy")).alias("sxy")))
    x = F.datediff("sale_date", F.lit(start)).cast("long")
    parts.append(daily_units(keep(rollup.daily, asked, by_day)).groupBy("item_id", "branch").agg(*_moments(x, F.col("quantity"))))
    sums = reduce(DataFrame.unionByName, parts).groupBy("item_id", "branch").agg(*[F.sum(c).alias(c) for c in MOMENTS])
    n, sx, sxx, sy, sxy = map(F.col, MOMENTS)
    slope = F.when(n > 1, F.try_divide(n * sxy - sx * sy, (n * sxx - sx * sx).cast("double")))
    per_item = sums.select("item_id", "branch", n.alias("points"), sy.alias("units"), (sy / n).alias("mean_daily"), F.round(slope, 9).alias("slope"))
    return per_item.withColumn("trend", L.trend_class(F.col("points"), F.col("slope")))


# ---- reports --------------------------------------------------------------------

def trend_report(tickets: DataFrame, days: int = 7, as_of: P.DateLike | None = None) -> DataFrame:
    """Every item and branch with its class, rounded for reading."""
    return report_of(weekly_trend(tickets, days, as_of))


def report_of(trends: DataFrame) -> DataFrame:
    """The report over trends that are already there."""
    return trends.select(
        "item_id", "branch", "points", M.fixed(F.col("units"), 0).alias("units"),
        M.fixed(F.col("mean_daily"), 1).alias("mean_daily"),
        M.fixed(F.col("slope"), 2).alias("slope"), "trend",
    )


def trend_summary(tickets: DataFrame, days: int = 7, as_of: P.DateLike | None = None) -> DataFrame:
    """Items per branch and class, with their share of the branch."""
    return summary_of(weekly_trend(tickets, days, as_of))


def summary_of(trends: DataFrame) -> DataFrame:
    """The summary over trends that are already there.

    The window runs over the three class rows of a branch, not over its items.
    """
    classes = trends.groupBy("branch", "trend").agg(F.count(F.lit(1)).alias("items"))
    return (
        classes.withColumn("total_items", F.sum("items").over(Window.partitionBy("branch")))
        .withColumn("pct", F.round(F.col("items") * 100.0 / F.col("total_items"), 0))
        .orderBy("branch", "trend")
    )


def _with_alerts(trend: DataFrame, alerts: DataFrame, extra: list[str]) -> DataFrame:
    items = alerts.select("item_id", "item_key", "description", "family", "subfamily",
                          F.trim("supplier").alias("supplier"), "days_cover", "stk_total", *extra)
    return trend.join(items, "item_id")


def trend_detail(
    tickets: DataFrame, alerts: DataFrame, branch: str, trend: str = K.TREND_UP,
    n: int | None = 100, days: int = 7, as_of: P.DateLike | None = None,
) -> DataFrame:
    """Items of one branch and class with stock and budget, most sold first."""
    chosen = weekly_trend(tickets, days, as_of, branch).where(F.col("trend") == trend)
    return (
        _with_alerts(chosen, alerts, ["budget"])
        .select("item_key", "description", "family", "subfamily", "supplier",
                M.fixed(F.col("units"), 0).alias("units"),
                M.fixed(F.col("mean_daily"), 1).alias("mean_daily"),
                M.fixed(F.col("slope"), 2).alias("slope"), "days_cover", "stk_total", "budget")
        .orderBy(F.desc("units"), "item_key").transform(first, n).drop("item_key")
    )


def trend_items(
    tickets: DataFrame, alerts: DataFrame, trend: str = K.TREND_UP, branch: str | None = None,
    n: int | None = 30, days: int = 7, as_of: P.DateLike | None = None,
) -> DataFrame:
    """Items of one class over all branches (or one), most sold first."""
    chosen = weekly_trend(tickets, days, as_of, branch).where(F.col("trend") == trend)
    return (
        _with_alerts(chosen, alerts, [])
        .select("item_key", "description", "branch", "family", "subfamily", "supplier",
                M.fixed(F.col("units"), 0).alias("units"), M.fixed(F.col("slope"), 2).alias("slope"),
                "days_cover", "stk_total")
        .orderBy(F.desc("units"), "item_key", "branch").transform(first, n).drop("item_key")
    )


def trend_range(tickets: DataFrame, days: int = 7, as_of: P.DateLike | None = None) -> DataFrame:
    """First and last day of the trend window, with short labels."""
    span = tickets.sparkSession.range(1).select(P.resolve_as_of(tickets, as_of).alias("date_to"))
    start = F.date_sub("date_to", days - 1)
    return span.select(
        start.alias("date_from"), "date_to",
        L.day_label(start).alias("label_from"), L.day_label(F.col("date_to")).alias("label_to"),
    )


def urgency_index(detail: DataFrame) -> DataFrame:
    """Reorder urgency between zero and one, added to a trend detail.

    Growth relative to the item's own volume (0.4), nearness to an empty shelf (0.4) and
    purchase budget (0.2); growth and budget are scaled to the range found in the rows given.
    The range is one row read as a scalar subquery, so no task sees the whole report.
    """
    volume = F.when(F.col("mean_daily") == 0, F.lit(1.0)).otherwise(F.col("mean_daily"))
    growth = F.col("slope") / volume
    budget = F.col("budget")
    span = detail.agg(F.struct(
        F.min(growth).alias("growth_low"), F.max(growth).alias("growth_high"),
        F.min(budget).alias("budget_low"), F.max(budget).alias("budget_high"),
    )).scalar()

    def scaled(value: F.Column, name: str) -> F.Column:
        low, high = F.col(f"_span.{name}_low"), F.col(f"_span.{name}_high")
        return F.when(high > low, (value - low) / F.nullif(high - low, F.lit(0.0))).otherwise(value * 0.0)

    cover = F.col("days_cover")
    risk = F.when(cover.isNotNull(), (30 - F.least(F.greatest(cover, F.lit(0)), F.lit(30))) / 30.0)
    index = scaled(growth, "growth") * 0.4 + risk * 0.4 + scaled(budget, "budget") * 0.2
    others = detail.columns
    return (
        detail.withColumn("_span", span)
        .withColumn("stock_risk", risk)
        .withColumn("urgency_index", F.bround(index, 3))
        .withColumn("suggested_action", L.urgency_action("urgency_index"))
        .select("urgency_index", "suggested_action", *others, "stock_risk")
        .orderBy(F.desc_nulls_last("urgency_index"),
                 *[c for c in ("description", "branch") if c in others])
    )
