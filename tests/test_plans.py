"""Plans that must hold whatever the size of the data."""

import datetime as dt
import re

import pytest

from tendero.functions import predicates as P
from tendero.operators import pricing, sales, stock, trend
from tendero.plans.filters import SalesFilter
from tendero.plans.registry import QUERIES
from tendero.sources.star import item_facts


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_taken_without_a_full_sort(mart):
    text = plan(sales.top_sellers(mart.tickets))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_latest_rows_are_cut_before_the_shuffle(mart):
    text = plan(pricing.sale_vs_purchase(mart.tickets, mart.last_prices))
    assert text.count("WindowGroupLimit") == 2
    assert text.index("Final") < text.index("Exchange hashpartitioning(description") < text.index("Partial")


def test_totals_and_latest_prices_share_a_hash_aggregation(mart):
    assert "SortAggregate" not in plan(pricing.high_sales_low_margin(mart.tickets, mart.last_prices))


def test_only_needed_columns_are_read(mart):
    text = plan(sales.daily_profit(mart.tickets, "2000-02-01"))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"sale_date", "branch", "price_total", "cost_total"}


def test_periods_skip_months(mart):
    for df in (
        sales.daily_profit(mart.tickets, "2000-02-01"),
        trend.weekly_trend(mart.tickets),
        sales.monthly_profit(mart.tickets, (1999, 2001)),
        sales.year_over_year(mart.tickets, SalesFilter(), dt.date(2001, 6, 1), dt.date(2001, 6, 30)),
        stock.critical_with_sales(mart.alerts, mart.tickets),
    ):
        assert re.search(r"PartitionFilters: \[[^\]]*sale_month", plan(df))


def test_static_periods_are_pushed_into_the_scan(mart):
    text = plan(mart.tickets.where(P.in_period(mart.tickets, "2000-02-01", "2000-02-29")))
    assert "GreaterThanOrEqual(sale_date,2000-02-01)" in text


def test_one_scan_for_both_months(mart):
    df = sales.month_kpis(mart.tickets, mart.alerts, as_of=mart.newest)
    assert plan(df).count("price_total") and plan(df).count("FileScan parquet [sale_date") == 1


def test_list_is_cut_before_prices_are_joined(mart):
    text = plan(pricing.top_sellers_with_cost(mart.tickets, mart.last_prices))
    join = re.search(r"(SortMergeJoin|BroadcastHashJoin)", text).start()
    assert text.index("TakeOrderedAndProject", join) > join


def test_short_lists_read_the_alerts_once(mart):
    text = plan(stock.how_much_to_order(mart.alerts, mart.last_prices, SalesFilter(family="PROMO")))
    assert text.count("FileScan parquet") == 2 and "LeftSemi" not in text


@pytest.mark.parametrize("name", ["month_kpis", "trend_summary", "critical_with_sales", "family_margin_leaders", "urgency_index", "weekly_trend"])
def test_every_ticket_scan_has_a_month_filter(name, spark, sf_dir):
    scans = [x for x in plan(QUERIES[name](spark, sf_dir)).split("\n") if "FileScan" in x and "sale_month" in x]
    assert scans and all("PartitionFilters: []" not in x for x in scans)


def test_high_sales_reads_the_lines_once(mart):
    assert plan(pricing.high_sales_low_margin(mart.tickets, mart.last_prices)).count("sale_month") <= 2


def test_item_facts_need_no_sort(mart):
    assert "SortAggregate" not in plan(item_facts(mart.tickets, mart.newest))


def test_no_window_without_partition_in_urgency(mart):
    text = plan(trend.urgency_index(trend.trend_detail(mart.tickets, mart.alerts, "asia")))
    assert "Window " not in text and "Subquery" in text


def test_details_read_the_alert_table_once(mart):
    assert plan(stock.detail_budget(mart.alerts)).count("FileScan") == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert bad not in text
