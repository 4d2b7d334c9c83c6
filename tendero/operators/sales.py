"""Sales and profit reports over the sale lines."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tendero import constants as K
from tendero.functions import measures as M, predicates as P
from tendero.plans.filters import SalesFilter, first, keep

ITEM_FIELDS = ("subfamily", "family", "brands")


def _branches(flt: SalesFilter, default: Sequence[str]) -> Column:
    return P.by_branches("branch", flt.branches or default)


def top_sellers(
    tickets: DataFrame, flt: SalesFilter = SalesFilter(), n: int | None = 10,
    branches: Sequence[str] = K.SALE_BRANCHES,
) -> DataFrame:
    """Best-selling items per branch by sales amount."""
    rows = keep(tickets, flt.first_of(*ITEM_FIELDS), flt.sizes("size_label", "min_cc", "max_cc"),
                flt.period(tickets), _branches(flt, branches))
    return (
        rows.groupBy("description", "branch")
        .agg(
            M.total("price_total", 2).alias("sales"),
            M.total(M.profit(), 2).alias("profit"),
            M.total("quantity", 0).alias("units"),
            M.mean_margin().alias("margin_pct"),
        )
        .orderBy(F.desc("sales"), "description", "branch").transform(first, n)
    )


def sized_top_sellers(
    tickets: DataFrame, flt: SalesFilter, min_cc: int, n: int | None = 20,
    branches: Sequence[str] = K.SALE_BRANCHES,
) -> DataFrame:
    """Best sellers of one kind of item from a pack volume upwards."""
    rows = keep(tickets, flt.first_of(*ITEM_FIELDS), P.by_min_volume("description", min_cc),
                _branches(flt, branches))
    return (
        rows.groupBy("description", "branch")
        .agg(M.total("price_total", 2).alias("sales"), M.total("quantity", 0).alias("units"))
        .orderBy(F.desc("sales"), "description", "branch").transform(first, n)
    )


def sales_by_branch(tickets: DataFrame, flt: SalesFilter = SalesFilter()) -> DataFrame:
    """Sales, profit, units, margin and items sold of each branch."""
    rows = keep(tickets, flt.first_of(*ITEM_FIELDS), flt.period(tickets))
    return (
        rows.groupBy("branch")
        .agg(
            M.in_millions(F.sum("price_total"), 2).alias("sales_m"),
            M.in_millions(F.sum(M.profit()), 2).alias("profit_m"),
            M.total("quantity", 0).alias("units"),
            M.margin_of_sums().alias("margin_pct"),
            F.count_distinct("item_id").alias("items"),
        )
        .orderBy(F.desc("sales_m"), "branch")
    )


def family_margin_leaders(
    tickets: DataFrame,
    period: tuple[P.DateLike, P.DateLike] | None = None,
    min_family: float = K.MIN_FAMILY_SALES,
    min_item: float = K.MIN_ITEM_SALES,
    n: int | None = 8,
    branches: Sequence[str] = K.SALE_BRANCHES,
    days: int = 30,
    as_of: P.DateLike | None = None,
) -> DataFrame:
    """The family with the best mean margin and its best-selling items.

    Only families and items above their sales threshold take part. Without a period the
    report covers the day it is for and the ``days`` days before it.
    """
    if period is None:
        end = P.resolve_as_of(tickets, as_of)
        when = P.in_period(tickets, F.date_sub(end, days))
    else:
        when = P.in_period(tickets, *period)
    rows = keep(tickets, P.by_branches("branch", branches), when)
    winner = (
        rows.groupBy("family")
        .agg(
            F.sum("price_total").alias("sales"),
            F.avg("margin_ratio").alias("margin"),
            M.mean_margin().alias("margin_pct"),
            M.in_millions(F.sum("price_total"), 1).alias("sales_m"),
            M.in_millions(F.sum(M.profit()), 1).alias("profit_m"),
            F.count_distinct("item_id").alias("items"),
        )
        .where(F.col("sales") > min_family)
        .orderBy(F.desc("margin"), "family").limit(1)
    )
    # one row by construction, so broadcasting it is safe at any data size
    items = (
        keep(rows, P.present("description"))
        .join(F.broadcast(winner.select("family")), "family")
        .groupBy("description", "family", "subfamily")
        .agg(
            M.total("price_total", 2).alias("sales"),
            M.mean_margin().alias("margin_pct"),
            M.in_millions(F.sum("price_total"), 1).alias("sales_m"),
            M.total("quantity", 0).alias("units"),
        )
        .where(F.col("sales") > min_item)
        .orderBy(F.desc("sales"), "description", "subfamily").transform(first, n)
    )
    head = winner.select(F.lit("family").alias("row_type"), "family", "margin_pct", "sales_m",
                         "profit_m", "items")
    body = items.select(F.lit("item").alias("row_type"), "family", "subfamily", "description",
                        "margin_pct", "sales_m", "units")
    return head.unionByName(body, allowMissingColumns=True)


def before_after_event(
    tickets: DataFrame,
    event_date: dt.date | str = K.EVENT_DATE,
    branches: Sequence[str] = K.EVENT_BRANCHES,
    start: dt.date | str = K.EVENT_START,
    as_of: P.DateLike | None = None,
) -> DataFrame:
    """Sales per day of each branch before and since an event, such as an opening."""
    end = P.resolve_as_of(tickets, as_of)
    rows = keep(tickets, P.in_branches_exact("branch", branches), P.in_period(tickets, start, end))
    phase = F.when(F.col("sale_date") < P.as_date(event_date), "before").otherwise("after")
    sales_m, days = F.sum("price_total") / F.lit(M.MILLION), F.count_distinct("sale_date")
    return (
        rows.groupBy("branch", phase.alias("phase"))
        .agg(
            M.fixed(sales_m, 1).alias("sales_m"),
            days.alias("days"),
            M.fixed(F.try_divide(sales_m, days), 2).alias("sales_per_day_m"),
        )
        .orderBy("branch", F.desc("phase"))
    )


def month_kpis(
    tickets: DataFrame, alerts: DataFrame,
    branches: Sequence[str] = K.DASHBOARD_BRANCHES, as_of: P.DateLike | None = None,
) -> DataFrame:
    """One row: the latest month with data, the month before, and the purchase budget.

    Both months come from one scan that starts at the earlier one.
    """
    this_month = P.month_start(P.resolve_as_of(tickets, as_of))
    last_month = F.add_months(this_month, -1)
    rows = keep(tickets, P.by_branches("branch", branches),
                P.in_period(tickets, last_month, F.last_day(this_month)))
    is_now = F.col("sale_date") >= this_month

    def now(value: Column) -> Column:
        return F.sum(F.when(is_now, value))

    def before(value: Column) -> Column:
        return F.sum(F.when(~is_now, value))

    price, cost = F.col("price_total"), F.col("cost_total")
    needs = alerts.agg(F.struct(
        M.in_millions(F.sum("budget"), 2).alias("budget_m"),
        F.count_distinct("item_id").alias("items"),
    ).alias("needs"))
    return (
        rows.agg(
            M.in_millions(now(price), 2).alias("sales_m"),
            M.in_millions(now(M.profit()), 2).alias("profit_m"),
            M.fixed(F.try_divide(now(price) - now(cost), now(price)) * 100.0, 1).alias("margin_pct"),
            F.count_distinct(F.when(is_now, F.col("sale_date"))).alias("days"),
            M.in_millions(before(price), 2).alias("prev_sales_m"),
            M.in_millions(before(M.profit()), 2).alias("prev_profit_m"),
        )
        .withColumn("needs", needs.scalar())
        .select("*", "needs.*").drop("needs")
    )


def month_over_month(kpis: DataFrame, target_margin: float = K.TARGET_MARGIN_PCT) -> DataFrame:
    """Changes against the month before, sales per day and whether the margin meets the target."""
    return kpis.select(
        "*",
        M.change_pct(F.col("sales_m"), F.col("prev_sales_m")).alias("sales_change_pct"),
        M.change_pct(F.col("profit_m"), F.col("prev_profit_m")).alias("profit_change_pct"),
        F.coalesce(M.fixed(F.try_divide(F.col("sales_m"), F.col("days")), 1), F.lit(0.0)).alias("sales_per_day_m"),
        (F.col("margin_pct") >= target_margin).alias("margin_on_target"),
    )


def branch_sales_month(
    tickets: DataFrame, month: P.DateLike | None = None,
    branches: Sequence[str] = K.DASHBOARD_BRANCHES,
) -> DataFrame:
    """Sales and mean margin of each branch in one month (the newest with data by default)."""
    rows = keep(tickets, P.in_month(tickets, P.resolve_as_of(tickets, month)), P.by_branches("branch", branches))
    return (
        rows.groupBy("branch")
        .agg(M.in_millions(F.sum("price_total"), 2).alias("sales_m"), M.mean_margin().alias("margin_pct"))
        .orderBy(F.desc("sales_m"), "branch")
    )


def daily_profit(
    tickets: DataFrame, month: P.DateLike | None = None,
    branches: Sequence[str] = K.DASHBOARD_BRANCHES,
) -> DataFrame:
    """Profit of each day of one month (the newest with data by default)."""
    rows = keep(tickets, P.in_month(tickets, P.resolve_as_of(tickets, month)), P.by_branches("branch", branches))
    return (
        rows.groupBy("sale_date")
        .agg(M.in_millions(F.sum(M.profit()), 2).alias("profit_m"))
        .orderBy("sale_date")
    )


def monthly_profit(
    tickets: DataFrame, years: Sequence[int] = K.DEFAULT_YEARS,
    branches: Sequence[str] = K.DASHBOARD_BRANCHES,
) -> DataFrame:
    """Profit of each month of the given years."""
    rows = keep(tickets, P.by_branches("branch", branches), P.in_years(tickets, years))
    return (
        rows.groupBy(F.year("sale_date").alias("year"), F.month("sale_date").alias("month"))
        .agg(M.in_millions(F.sum(M.profit()), 3).alias("profit_m"))
        .orderBy("year", "month")
    )


def monthly_profit_pivot(
    tickets: DataFrame, years: Sequence[int] = K.DEFAULT_YEARS,
    branches: Sequence[str] = K.DASHBOARD_BRANCHES,
) -> DataFrame:
    """Months as rows, years as columns: the table behind grouped bars."""
    monthly = monthly_profit(tickets, years, branches)
    wide = monthly.groupBy("month").pivot("year", list(years)).agg(F.first("profit_m"))
    return wide.select(
        "month", *[F.col(str(y)).alias(f"profit_m_{y}") for y in years],
    ).orderBy("month")


def last_data_date(tickets: DataFrame) -> DataFrame:
    """Newest sale date."""
    return tickets.sparkSession.range(1).select(P.last_date(tickets).alias("last_date"))


def category_branch_month(tickets: DataFrame, subfamily: str, year: int, month: int) -> DataFrame:
    """Sales and units of one subfamily per branch in one month."""
    rows = keep(tickets, P.by_subfamily("subfamily", subfamily),
                P.in_month(tickets, dt.date(year, month, 1)))
    return (
        rows.groupBy("branch")
        .agg(M.in_millions(F.sum("price_total"), 2).alias("sales_m"),
             M.total("quantity", 0).alias("units"))
        .orderBy(F.desc("sales_m"), "branch")
    )


def _year_before(day: dt.date) -> dt.date:
    try:
        return day.replace(year=day.year - 1)
    except ValueError:  # 29 February
        return dt.date(day.year - 1, 2, 28)


def year_over_year(
    tickets: DataFrame, flt: SalesFilter, start: dt.date, end: dt.date,
) -> DataFrame:
    """Sales of the same days in this year and the year before."""
    rows = keep(
        tickets, flt.first_of(*ITEM_FIELDS),
        P.in_period(tickets, start, end)
        | P.in_period(tickets, _year_before(start), _year_before(end)),
    )
    return (
        rows.groupBy(F.year("sale_date").alias("year"))
        .agg(M.in_millions(F.sum("price_total"), 1).alias("sales_m"))
        .orderBy("year")
    )


RANK_BY = ("units", "sales", "profit", "margin_pct")


def items_ranked(
    tickets: DataFrame, by: str = "units", n: int | None = 10, flt: SalesFilter = SalesFilter(),
) -> DataFrame:
    """Items ranked by units, sales, profit or margin.

    Grouped by description alone: family and subfamily can differ between the lines of one
    item, and grouping by them would split its total. Any of their values will do; the
    smallest is taken, so a repeated task returns the same one.
    """
    if by not in RANK_BY:
        raise ValueError(f"rank by one of {', '.join(RANK_BY)}")
    rows = keep(tickets, flt.first_of(*ITEM_FIELDS), flt.period(tickets),
                P.by_branches("branch", flt.branches) if flt.branches else None)
    return (
        rows.groupBy("description")
        .agg(
            F.min("family").alias("family"),
            F.min("subfamily").alias("subfamily"),
            M.total("quantity", 0).alias("units"),
            M.total("price_total", 2).alias("sales"),
            M.total(M.profit(), 2).alias("profit"),
            M.margin_of_sums().alias("margin_pct"),
        )
        .orderBy(F.desc_nulls_last(by), "description").transform(first, n)
    )
