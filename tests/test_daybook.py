"""Day totals with sets of items, against reports over all lines."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tendero.operators import daybook, sales
from tendero.plans.filters import SalesFilter
from tendero.sources import snapshots
from tendero.sources.mart import load_mart, write_mart

SCHEMA = "branch string, sale_date date, item_id long, quantity double, price_total double, cost_total double"
DAY = dt.date(2024, 1, 31)


@pytest.fixture(scope="module")
def kept(spark, mart, tmp_path_factory):
    """Versions of a mart: in two batches that share days, and put together."""
    base = str(tmp_path_factory.mktemp("daybook"))
    write_mart(replace(mart, tickets=mart.tickets.where("item_id % 3 != 0")), base)
    snapshots.append_lines(mart.tickets.where("item_id % 3 = 0"), base)
    snapshots.compact_lines(spark, base)
    return [load_mart(spark, base, version=v) for v in (2, 3)]


@pytest.mark.parametrize(("since", "until"), [(None, None), ("1997-03-10", "1999-01-02"), ("1998-06-05", "1998-06-05"), ("2050-01-01", None)])
def test_branch_totals_equal_the_report_over_lines(mart, kept, since, until):
    wanted = sales.sales_by_branch(mart.tickets, SalesFilter(date_from=since, date_to=until)).collect()
    for m in kept:
        assert daybook.branch_totals(m.sold, since, until).collect() == wanted
    assert bool(wanted) == (since != "2050-01-01")


def test_items_of_months_are_united_and_not_added(mart, kept):
    month = F.trunc("sale_date", "month").cast("date").alias("month")
    wanted = {r["month"]: r["n"] for r in mart.tickets.where("branch IN ('asia', 'europe')").groupBy(month).agg(F.count_distinct("item_id").alias("n")).collect()}
    for m in kept:
        assert {r["month"]: r["items"] for r in daybook.month_totals(m.sold, ("Asia", "EUROPE")).collect()} == wanted
    days = kept[1].sold.groupBy(month).agg(F.sum(F.bitmap_count("items")).alias("n")).collect()
    assert any(r["n"] > wanted[r["month"]] for r in days if r["month"] in wanted)


def test_no_lines_are_read_and_nothing_is_expanded(kept):
    rows = daybook.branch_totals(kept[1].sold)
    assert not any("/tickets/" in f for f in rows.inputFiles())
    assert "Expand" not in rows._jdf.queryExecution().executedPlan().toString()


def test_odd_lines(spark):
    big = 2**62
    rows = [("a", DAY, i, 1.0, 2.0, 1.0) for i in (1, 1, 0, -1, -40_000, 32_768, 32_769, big, big + 1)]
    rows += [("a", DAY, None, 1.0, 2.0, 1.0), ("b", DAY, None, None, None, None), (None, DAY, 5, 1.0, 2.0, None), ("b", None, 5, 1.0, 1.0, 1.0)]
    lines = spark.createDataFrame(rows, SCHEMA)
    once = daybook.day_sales(lines)
    twice = daybook.day_sales(daybook.day_sales(lines.where("item_id > 0")).union(daybook.day_sales(lines.where("item_id <= 0 OR item_id IS NULL"))))
    wanted = sales.sales_by_branch(lines).collect()
    assert {r["branch"]: r["items"] for r in wanted} == {"a": 8, "b": 1, None: 1}
    for sold in (once, twice):
        assert daybook.branch_totals(sold).collect() == wanted
    assert [r["month"] for r in daybook.month_totals(once).collect()] == [None, dt.date(2024, 1, 1)]
    assert daybook.branch_totals(daybook.day_sales(lines.where("false"))).collect() == []


def test_sets_are_made_before_anything_moves(spark):
    lines = spark.createDataFrame([("a", DAY, 1, 1.0, 2.0, 1.0)], SCHEMA)
    plan = daybook.day_sales(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "item_id" not in plan[plan.index("Exchange hashpartitioning"):].split("\n")[0]
