"""Hand-made sale lines: ties, zero cost, empty results, both branch sets."""

import datetime as dt

import pytest

from tendero import constants as K
from tendero.functions import labels as L
from tendero.operators import marks, pricing, sales, trend
from tendero.plans.filters import SalesFilter

COLUMNS = ("sale_date date, order_id long, line_no int, item_id long, item_key long, description string, "
           "family string, subfamily string, branch string, quantity double, price_total double, "
           "cost_total double, price_unit double, cost_unit double, margin_ratio double")


def line(day, order=1, no=1, item=1, what="Quilmes 1L", family="Bebidas", sub="Cervezas", branch="hiper",
         units=1.0, price=10.0, cost=8.0):
    margin = (price - cost) / price if price else None
    return (dt.date.fromisoformat(day), order, no, item, item, what, family, sub, branch,
            units, price, cost, price / units, cost / units, margin)


def tickets(spark, *lines):
    return spark.createDataFrame(list(lines), COLUMNS)


def values(df):
    return [tuple(r) for r in df.collect()]


def test_top_sellers_default_branches_leave_out_express(spark):
    t = tickets(spark, line("2026-06-01"), line("2026-06-01", branch="express", price=99.0),
                line("2026-06-02", branch="HIPER", price=5.0))
    rows = {r["branch"]: r["sales"] for r in sales.top_sellers(t).collect()}
    assert rows == {"hiper": 10.0, "HIPER": 5.0}


def test_dashboard_branches_include_express(spark):
    t = tickets(spark, line("2026-06-01"), line("2026-06-01", branch="express"))
    assert sales.branch_sales_month(t).count() == 2


def test_equal_sales_are_listed_by_name(spark):
    t = tickets(spark, line("2026-06-01", what="b"), line("2026-06-01", what="a"))
    assert [r["description"] for r in sales.top_sellers(t, n=1).collect()] == ["a"]


def test_sums_do_not_depend_on_partitions(spark):
    t = tickets(spark, *[line("2026-06-01", order=i, price=0.1, cost=0.07) for i in range(350)])
    one = sales.sales_by_branch(t.repartition(1)).collect()
    many = sales.sales_by_branch(t.repartition(17)).collect()
    assert one == many


def test_month_kpis_on_a_first_month(spark):
    t = tickets(spark, line("2026-06-01"), line("2026-06-03", branch="sabin", price=30.0, cost=10.0))
    alerts = spark.createDataFrame([(1, 5e6), (2, None)], "item_id long, budget double")
    row = sales.month_over_month(sales.month_kpis(t, alerts)).first()
    assert (row["days"], row["prev_sales_m"], row["sales_change_pct"]) == (2, None, None)
    assert (row["margin_pct"], row["margin_on_target"], row["budget_m"], row["items"]) == (55.0, True, 5.0, 2)


def test_change_against_zero_counts_from_one(spark):
    k = spark.createDataFrame([(3.0, 0.0, 1.0, 2.0, 0, 10.0)],
                              "sales_m double, prev_sales_m double, profit_m double, "
                              "prev_profit_m double, days long, margin_pct double")
    row = sales.month_over_month(k).first()
    assert (row["sales_change_pct"], row["profit_change_pct"], row["sales_per_day_m"]) == (200.0, -50.0, 0.0)


def test_months_are_calendar_months(spark):
    t = tickets(spark, line("2026-01-31"), line("2025-12-31", price=20.0), line("2025-11-30", price=70.0))
    alerts = spark.createDataFrame([(1, 1.0)], "item_id long, budget double")
    row = sales.month_kpis(t, alerts).first()
    assert (row["sales_m"], row["prev_sales_m"]) == (0.0, 0.0)  # 10 and 20 in millions
    assert row["days"] == 1


def test_family_below_the_threshold_is_left_out(spark):
    t = tickets(spark, line("2026-06-01", family="A", price=100.0, cost=90.0),
                line("2026-06-01", family="B", price=10.0, cost=1.0))
    assert sales.family_margin_leaders(t, min_family=50, min_item=1).first()["family"] == "A"
    assert sales.family_margin_leaders(t).count() == 0


def test_before_after_counts_days_once(spark):
    t = tickets(spark, line("2026-06-05"), line("2026-06-05"), line("2026-06-06"), line("2026-04-30"))
    rows = {r["phase"]: r["days"] for r in sales.before_after_event(t).collect()}
    assert rows == {"before": 1, "after": 1}


def test_years_compare_the_same_days(spark):
    t = tickets(spark, line("2026-06-10"), line("2025-06-10"), line("2025-07-01"), line("2024-06-10"))
    rows = sales.year_over_year(t, SalesFilter(), dt.date(2026, 6, 1), dt.date(2026, 6, 30)).collect()
    assert [r["year"] for r in rows] == [2025, 2026]


def test_leap_day_compares_with_the_28th():
    assert sales._year_before(dt.date(2024, 2, 29)) == dt.date(2023, 2, 28)


def test_item_with_two_families_is_ranked_once(spark):
    t = tickets(spark, line("2026-06-01", family="B"), line("2026-06-01", family="A"), line("2026-06-01", family=None))
    assert [(r["family"], r["units"]) for r in sales.items_ranked(t).collect()] == [("A", 3.0)]


def test_unknown_ranking_is_refused(spark):
    with pytest.raises(ValueError):
        sales.items_ranked(tickets(spark, line("2026-06-01")), "colour")


def test_latest_price_among_lines_of_one_day(spark):
    t = tickets(spark, line("2026-06-02", order=2, price=20.0), line("2026-06-02", order=1, price=30.0),
                line("2026-06-01", price=5.0), line("2026-06-03", price=0.0))
    assert values(pricing.last_sale_price(t)) == [("Quilmes 1L", dt.date(2026, 6, 2), 30.0)]


def test_latest_price_without_order_numbers(spark):
    t = tickets(spark, line("2026-06-02", price=20.0), line("2026-06-02", price=15.0)).drop("order_id", "line_no")
    assert pricing.last_sale_price(t).first()["last_sale_price"] == 15.0


def prices(spark, *rows):
    return spark.createDataFrame(
        [(k, c, dt.date(2026, 5, 1), " ACME ") for k, c in rows],
        "item_key long, last_cost double, last_po_date date, po_supplier string")


def test_zero_cost_gives_no_margin_and_comes_last(spark):
    t = tickets(spark, line("2026-06-01", item=1, what="a"), line("2026-06-01", item=2, what="b"))
    rows = pricing.sale_vs_purchase(t, prices(spark, (1, 0.0), (2, 8.0))).collect()
    assert [(r["description"], r["real_margin_pct"]) for r in rows] == [("b", 25.0), ("a", None)]
    assert rows[0]["po_supplier"] == "ACME"


def test_best_sellers_without_price_stay(spark):
    t = tickets(spark, line("2026-06-01", item=1, what="a", units=5.0), line("2026-06-01", item=2, what="b"))
    rows = pricing.top_sellers_with_cost(t, prices(spark, (2, 8.0))).collect()
    assert [(r["description"], r["last_cost"]) for r in rows] == [("a", None), ("b", 8.0)]


def test_margin_uses_one_price_per_item_key(spark):
    t = tickets(spark, line("2026-06-01", item=1, what="old name", price=10.0),
                line("2026-06-02", item=1, what="new name", price=12.0))
    rows = pricing.high_sales_low_margin(t, prices(spark, (1, 10.0))).collect()
    assert {(r["description"], r["last_sale_price"], r["real_margin_pct"]) for r in rows} == {
        ("old name", 12.0, 20.0), ("new name", 12.0, 20.0)}


def test_trend_needs_two_days(spark):
    t = tickets(spark, line("2026-06-07", item=1, units=9.0), line("2026-06-07", item=1, units=9.0),
                line("2026-06-01", item=2, units=1.0), line("2026-06-07", item=2, units=4.0),
                line("2026-06-06", item=3, units=4.0), line("2026-06-07", item=3, units=1.0),
                line("2026-05-31", item=4, units=4.0))
    rows = {r["item_id"]: (r["points"], r["trend"]) for r in trend.weekly_trend(t).collect()}
    assert rows == {1: (1, K.TREND_FLAT), 2: (2, K.TREND_UP), 3: (2, K.TREND_DOWN)}


def test_slope_on_the_threshold_is_flat(spark):
    t = tickets(spark, *[line(f"2026-06-0{d}", units=1.0 + 0.1 * d) for d in range(1, 8)])
    assert trend.weekly_trend(t).first()["trend"] == K.TREND_FLAT


def detail(spark, *rows):
    return spark.createDataFrame(list(rows), "description string, mean_daily double, slope double, "
                                             "days_cover long, budget double")


def test_urgency_by_hand(spark):
    rows = trend.urgency_index(detail(
        spark, ("a", 2.0, 2.0, 0, 100.0), ("b", 1.0, 0.0, 30, 0.0), ("c", 0.0, 0.5, 45, 50.0),
        ("d", 1.0, None, 3, 10.0))).collect()
    got = {r["description"]: (r["urgency_index"], r["suggested_action"]) for r in rows}
    assert got["a"] == (1.0, "🔴 Comprar ya")
    assert got["b"] == (0.0, "🟢 Sin urgencia")
    assert got["c"] == (0.3, "🟡 Monitorear")
    assert got["d"] == (None, "🟢 Sin urgencia")
    assert rows[-1]["description"] == "d"


def test_urgency_of_equal_rows_has_no_range(spark):
    rows = trend.urgency_index(detail(spark, ("a", 1.0, 1.0, 15, 5.0), ("b", 1.0, 1.0, -2, 5.0))).collect()
    assert [r["urgency_index"] for r in rows] == [0.4, 0.2]


def test_marks(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, v double")
    assert [r["above_mean"] for r in marks.flag_above_mean(df, "v").orderBy("k").collect()] == [False, True, True]
    assert [r["extreme"] for r in marks.flag_extremes(df, "v").orderBy("k").collect()] == ["min", "other", "max"]


def test_margin_bands(spark):
    df = spark.createDataFrame([(-0.1,), (0.0,), (9.99,), (10.0,), (None,)], "m double")
    bands = [r[0] for r in df.select(L.margin_band("m")).collect()]
    assert bands == ["negative", "low", "low", "healthy", None]


def test_short_dates(spark):
    t = tickets(spark, line("2026-01-03"))
    row = trend.trend_range(t).first()
    assert (row["label_from"], row["label_to"]) == ("28 dic", "3 ene")


def test_branch_totals_add_up(mart):
    all_items = sales.top_sellers(mart.tickets, n=1_000_000, branches=("asia", "europe", "africa",
                                                                        "america", "middle east"))
    by_branch = {r["branch"]: r["sales_m"] for r in sales.sales_by_branch(mart.tickets).collect()}
    for r in all_items.groupBy("branch").sum("sales").collect():
        assert abs(r[1] / 1e6 - by_branch[r["branch"]]) < 0.006


def test_trend_counts_add_up(mart):
    for r in trend.trend_summary(mart.tickets, 90).groupBy("branch", "total_items").sum("items").collect():
        assert r["total_items"] == r["sum(items)"]


def test_urgency_stays_between_zero_and_one(mart):
    detail_rows = trend.trend_detail(mart.tickets, mart.alerts, "asia", "estable", n=10_000, days=700)
    index = [r["urgency_index"] for r in trend.urgency_index(detail_rows).collect()]
    scored = [i for i in index if i is not None]
    assert scored and all(0 <= i <= 1 for i in scored)
    assert index == sorted(scored, reverse=True) + [None] * (len(index) - len(scored))
