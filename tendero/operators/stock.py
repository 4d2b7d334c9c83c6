"""Stock, restocking alerts and money lost to empty shelves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tendero import constants as K
from tendero.functions import labels as L, measures as M, predicates as P
from tendero.plans.filters import SalesFilter, first, keep, nothing

ITEM_FIELDS = ("subfamily", "family", "brands")


def _with_prefix(df: DataFrame, prefix: str, but: Sequence[str] = ()) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and c not in but]


def _supplier() -> Column:
    return F.trim("supplier").alias("supplier")


def _branch_stock(df: DataFrame) -> list[str]:
    return _with_prefix(df, "stk_", but=("stk_total",))


def _stock_of(df: DataFrame, branches: Sequence[str]) -> list[str]:
    """Stock columns of the branches, or of all where the table knows none of them."""
    named = [f"stk_{b}" for b in branches if f"stk_{b}" in df.columns]
    return named or _branch_stock(df)


def stock_by_category(
    catalog: DataFrame, flt: SalesFilter, n: int | None = 10,
    branches: Sequence[str] = K.DASHBOARD_BRANCHES,
) -> DataFrame:
    """Stock per branch of the items asked for; needs a subfamily or brands."""
    item = flt.first_of("subfamily", "brands")
    rows = nothing(catalog) if item is None else keep(catalog, item)
    return (
        rows.orderBy(F.desc_nulls_last("stk_total"), "item_key").transform(first, n)
        .select(F.trim("description").alias("description"), "subfamily", _supplier(),
                *_stock_of(catalog, branches), "stk_total")
    )


def bestsellers_at_risk(
    alerts: DataFrame, flt: SalesFilter = SalesFilter(), urgent: bool = False, n: int | None = 20,
) -> DataFrame:
    """Most sold items about to run out: within a week if urgent, else within thirty days."""
    rows = keep(alerts, P.needs_restock(), P.positive("units_90d"),
                flt.first_of(*ITEM_FIELDS), P.cover_between(None, 7 if urgent else 30))
    return (
        rows.orderBy(F.desc("units_90d"), "item_key").transform(first, n)
        .select(
            "description", "family", "subfamily", _supplier(), "units_90d", "stk_total",
            "days_cover", "risk_level", "abc_class", F.col("budget").alias("budget_30d"),
            "to_order", "lost_value", L.coverage_label("days_cover", "at_risk").alias("alert"),
        )
    )


def critical_with_sales(
    alerts: DataFrame, tickets: DataFrame, flt: SalesFilter = SalesFilter(),
    as_of: P.DateLike | None = None, n: int | None = 20,
    branches: Sequence[str] = K.SALE_BRANCHES[:3],
) -> DataFrame:
    """Items with two weeks of cover or less, with their sales of the month so far."""
    start = P.month_start(P.resolve_as_of(tickets, as_of))
    month = keep(tickets, P.in_period(tickets, start)).groupBy("item_key").agg(
        M.total("price_total", 2).alias("month_sales"),
        M.total("quantity", 0).alias("month_units"),
    )
    rows = keep(alerts, P.cover_between(0, 14), flt.all_of("subfamily", "brands"))
    return (
        rows.withColumn("item_key", F.col("item_key").cast("long"))
        .join(month, "item_key", "left")
        .select(
            "item_key", "description", "family", "subfamily", "supplier", "days_cover", "risk_level",
            "stk_total", *_stock_of(alerts, branches), "abc_class",
            F.coalesce("month_sales", F.lit(0.0)).alias("month_sales"),
            F.coalesce("month_units", F.lit(0.0)).alias("month_units"),
            L.coverage_label("days_cover", "critical").alias("level"),
        )
        .orderBy("days_cover", F.desc("month_sales"), "item_key").transform(first, n).drop("item_key")
    )


def lost_sales_value(alerts: DataFrame, flt: SalesFilter = SalesFilter(), n: int | None = 15) -> DataFrame:
    """Items that lost most money while out of stock."""
    rows = keep(alerts, P.positive("lost_value"), flt.first_of("subfamily", "family"))
    return (
        rows.orderBy(F.desc("lost_value"), "item_key").transform(first, n)
        .select("description", "family", "subfamily", _supplier(), "lost_value", "lost_units",
                "days_cover", "stk_total", "risk_level")
    )


def lost_sales_summary(alerts: DataFrame) -> DataFrame:
    """Money, units and items lost to empty shelves, in one row."""
    return keep(alerts, P.positive("lost_value")).agg(
        M.total("lost_value", 2).alias("lost_value"),
        F.sum("lost_units").alias("lost_units"),
        F.count(F.lit(1)).alias("items"),
    )


def budget_by_supplier(alerts: DataFrame, flt: SalesFilter = SalesFilter(), n: int | None = 15) -> DataFrame:
    """Purchase budget of the next thirty days per supplier; padded names count as one."""
    rows = keep(alerts, P.positive("budget"), flt.first_of("subfamily", "family"))
    return (
        rows.groupBy(_supplier())
        .agg(
            F.count(F.lit(1)).alias("items"),
            M.total("budget", 2).alias("budget_total"),
            M.fixed(F.avg("days_cover"), 1).alias("mean_days_cover"),
        )
        .orderBy(F.desc("budget_total"), "supplier").transform(first, n)
    )


def excess_for_transfer(
    alerts: DataFrame, flt: SalesFilter = SalesFilter(), n: int | None = 15,
    branches: Sequence[str] = K.SALE_BRANCHES,
) -> DataFrame:
    """Items with more stock than needed and where it lies."""
    rows = keep(alerts, P.positive("excess"), flt.first_of(*ITEM_FIELDS))
    return (
        rows.orderBy(F.desc("excess"), "item_key").transform(first, n)
        .select("description", "family", "subfamily", "excess", *_stock_of(alerts, branches), "days_cover")
    )


def offer_candidates(
    alerts: DataFrame, flt: SalesFilter = SalesFilter(), n: int | None = 20,
    min_markup: float = K.OFFER_MARKUP,
) -> DataFrame:
    """Overstocked items that still sell and leave room for a discount."""
    rows = keep(alerts, P.positive("excess"), P.markup_above("price_now", "cost_unit", min_markup),
                P.positive("units_90d"), flt.first_of(*ITEM_FIELDS))
    return (
        rows.orderBy(F.desc("excess"), "item_key").transform(first, n)
        .select(
            "description", "family", "subfamily", _supplier(), "excess", "stk_total", "days_cover",
            M.fixed(F.col("price_now"), 2).alias("price_now"),
            M.fixed(F.col("cost_unit"), 2).alias("cost_unit"),
            M.markup_pct(F.col("price_now"), F.col("cost_unit"), 1).alias("margin_pct"),
            "units_90d",
        )
    )


def _with_purchase_price(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Add the latest purchase price where there is one.

    The join carries no hint: a list cut to few rows is broadcast by its measured size.
    """
    price = prices.select(
        "item_key", M.fixed(F.col("last_cost"), 2).alias("last_cost"),
        F.trim("po_supplier").alias("po_supplier"),
        F.col("last_po_date").cast("date").alias("last_po_date"),
    )
    return rows.join(price, "item_key", "left")


def how_much_to_order(
    alerts: DataFrame, prices: DataFrame, flt: SalesFilter, n: int | None = 15,
) -> DataFrame:
    """Units to order, from whom and at what price; needs brands, a subfamily or a family."""
    item = flt.first_of("brands", "subfamily", "family")
    rows = nothing(alerts) if item is None else keep(alerts, P.positive("to_order"), item)
    best = rows.orderBy(F.desc_nulls_last("budget"), "item_key").transform(first, n)
    return (
        _with_purchase_price(best, prices)
        .orderBy(F.desc_nulls_last("budget"), "item_key")
        .select("description", "family", "subfamily", _supplier(), "to_order", "budget", "days_cover",
                "stk_total", "units_90d", "last_cost", "po_supplier", "last_po_date")
    )


def restock_by_supplier(
    alerts: DataFrame, prices: DataFrame, supplier: str, n: int | None = 20,
) -> DataFrame:
    """What to reorder from one supplier, largest budget first."""
    rows = keep(alerts, P.by_supplier("supplier", supplier), P.needs_restock())
    largest = [F.desc_nulls_last("budget"), F.col("item_key")]
    best = rows if n is None else rows.orderBy(*largest).limit(n)
    return (
        _with_purchase_price(best, prices)
        .orderBy(*largest)
        .select("description", "family", "subfamily", _supplier(), "days_cover", "stk_total",
                "units_90d", "to_order", "budget", "risk_level", "last_cost", "po_supplier",
                "last_po_date")
    )


def alert_kpis(alerts: DataFrame) -> DataFrame:
    """Counts and amounts of the alert table in one row and one pass."""
    restock, cover = P.needs_restock(), F.col("days_cover")

    def rows_with(test: Column) -> Column:
        return F.sum(F.when(test, 1).otherwise(0))

    return alerts.agg(
        F.count(F.lit(1)).alias("items"),
        rows_with(restock & (cover == 0)).alias("no_stock"),
        rows_with(restock & (cover > 0) & (cover <= 3)).alias("critical"),
        rows_with(restock & (cover > 3) & (cover <= 7)).alias("urgent"),
        rows_with(P.positive("excess")).alias("excess"),
        M.in_millions(F.sum("lost_value"), 1).alias("lost_value_m"),
        M.in_millions(F.sum("budget"), 1).alias("budget_m"),
    )


# ---- detail lists behind the alert figures -----------------------------------

def _detail(alerts: DataFrame, test: Column, extra: Sequence[str], n: int | None, order_by: str) -> DataFrame:
    return (
        keep(alerts, test)
        .orderBy(F.desc_nulls_last(order_by), "item_key").transform(first, n)
        .select("description", "family", "subfamily", _supplier(), "days_cover", "pack_units", *extra,
                *_branch_stock(alerts), "stk_total", *_with_prefix(alerts, "order_"), "to_order",
                "budget")
    )


def detail_no_stock(alerts: DataFrame, n: int | None = 50) -> DataFrame:
    return _detail(alerts, P.needs_restock() & P.cover_between(0, 0), ["units_90d"], n, "budget")


def detail_critical(alerts: DataFrame, n: int | None = 50) -> DataFrame:
    return _detail(alerts, P.needs_restock() & P.cover_between(1, 3), ["units_90d"], n, "budget")


def detail_urgent(alerts: DataFrame, n: int | None = 50) -> DataFrame:
    return _detail(alerts, P.needs_restock() & P.cover_between(4, 7), ["units_90d"], n, "budget")


def detail_excess(alerts: DataFrame, n: int | None = 50) -> DataFrame:
    return _detail(alerts, P.positive("excess"), ["excess"], n, "budget")


def detail_lost_value(alerts: DataFrame, n: int | None = 50, order_by: str = "budget") -> DataFrame:
    return _detail(alerts, P.positive("lost_value"), ["lost_value", "lost_units"], n, order_by)


def detail_budget(alerts: DataFrame, n: int | None = 50) -> DataFrame:
    return _detail(alerts, P.positive("budget"), [], n, "budget")


def seasonal_items(
    alerts: DataFrame, max_rank: int = 3, few_months: int = K.FEW_ACTIVE_MONTHS, n: int | None = None,
) -> DataFrame:
    """Items in one of their best or worst months of the year.

    Rank one is an item's best month, twelve its worst. Items sold in fewer than
    ``few_months`` months are marked as strongly seasonal.
    """
    rank = F.col("month_rank")
    moment = F.when(rank <= max_rank, "best").when(rank > 12 - max_rank, "worst")
    report = (
        alerts.withColumn("moment", moment).where(P.present("moment"))
        .select("item_key", "description", "family", "subfamily", "moment", "month_rank",
                "active_months", (F.col("active_months") < few_months).alias("strongly_seasonal"),
                "units_90d", "stk_total")
        .orderBy("month_rank", F.desc("units_90d"), "item_key")
    )
    return report if n is None else report.transform(first, n)
