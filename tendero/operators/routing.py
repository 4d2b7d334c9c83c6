"""Which report answers a tagged question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tendero.functions import words as W
from tendero.functions.text import any_phrase, fold


def _rules() -> tuple[tuple, Column, tuple]:
    """Rules in order as (test, report), those before and after the test for an item."""
    folded = F.col("_folded")

    def says(phrases: tuple[str, ...]) -> Column:
        return any_phrase(folded, phrases)

    category, subfamily, family = (F.col(c).isNotNull() for c in ("category", "subfamily", "family"))
    brands = F.size("brands") > 0
    supplier = F.col("supplier").isNotNull()
    min_cc, max_cc, size = (F.col(c).isNotNull() for c in ("min_cc", "max_cc", "size_label"))
    price, ranking, stock, alert = (
        F.col(c) for c in ("wants_price", "wants_ranking", "wants_stock", "wants_alert"))
    compare = says(W.COMPARE_PRICES)
    gate = category | brands | min_cc | supplier

    before_gate = (
        (says(W.BELOW_COST_FIRST), "below_cost"),
        (says(W.LOST_VALUE_FIRST), "lost_sales_value"),
        (says(W.BY_BRANCH) & (category | brands | subfamily), "sales_by_branch"),
        (says(W.FROM_SUPPLIER) & supplier, "restock_by_supplier"),
        (says(W.HOW_MUCH_TO_ORDER) & (brands | subfamily | family), "how_much_to_order"),
        (says(W.OFFER), "offer_candidates"),
        (says(W.TREND), "trend_items"),
        (says(W.LOST_VALUE_WIDE), "lost_sales_value"),
        (says(W.BELOW_COST_WIDE), "below_cost"),
    )
    after_gate = (
        (says(W.OFFER_WIDE), "offer_candidates"),
        (says(W.EVENT_IMPACT), "before_after_event"),
        (says(W.BUDGET), "budget_by_supplier"),
        (says(W.TRANSFER), "excess_for_transfer"),
        (says(W.FAMILY_MARGIN), "family_margin_leaders"),
        (says(W.THIN_MARGIN), "high_sales_low_margin"),
        (says(W.CRITICAL) | (alert & stock), "critical_with_sales"),
        (compare & category, "sale_vs_purchase"),
        (price & ranking, "top_sellers_with_cost"),
        (price & ~ranking & ~compare & (subfamily | family | brands | size | min_cc | max_cc),
         "purchase_prices"),
        (says(W.AT_RISK) | (ranking & stock), "bestsellers_at_risk"),
        (stock & (subfamily | brands), "stock_by_category"),
        (ranking | min_cc | size | category, "top_sellers"),
    )
    return before_gate, gate, after_gate


def route_label(df: DataFrame, text_col: str) -> DataFrame:
    """Add ``route``, the name of the report a tagged text asks for, or null.

    The rules are tried in order and the first that holds decides, one conditional
    expression per row. A rule also asks for the tags without which its report has no rows
    to look for. Past the narrow rules a text must at least name a kind of item, a
    brand, a volume or a supplier.
    """
    before_gate, gate, after_gate = _rules()
    route = F
    for test, label in before_gate:
        route = route.when(test, label)
    route = route.when(~gate, F.lit(None).cast("string"))
    for test, label in after_gate:
        route = route.when(test, label)
    return (
        df.withColumn("_folded", fold(F.trim(F.col(text_col))))
        .withColumn("route", route.otherwise(F.lit(None).cast("string")))
        .drop("_folded")
    )


def all_routes(df: DataFrame, text_col: str) -> DataFrame:
    """Add ``routes``, every report whose rule holds, in the order of the rules."""
    before_gate, gate, after_gate = _rules()
    named = [F.when(test, label) for test, label in before_gate]
    named += [F.when(gate & test, label) for test, label in after_gate]
    return (
        df.withColumn("_folded", fold(F.trim(F.col(text_col))))
        .withColumn("routes", F.array_distinct(F.array_compact(F.array(*named))))
        .drop("_folded")
    )


def route_counts(df: DataFrame) -> DataFrame:
    """Texts per report."""
    return df.groupBy("route").agg(F.count(F.lit(1)).alias("texts")).orderBy(F.desc("texts"), "route")
