"""The registered queries: every operator over the given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tendero.functions import labels as L, predicates as P
from tendero.operators import (
    daybook, marks, pricing, routing, sales, selectors, stock, tagging, trend,
)
from tendero.plans import samples as X
from tendero.plans.filters import SalesFilter, keep
from tendero.sources import question_log, sinks
from tendero.sources.mart import Mart, load_mart, nulled_values, run_select, unparsed_dates, write_mart
from tendero.sources.shared import new_path
from tendero.sources.snapshots import append_lines, compact_lines
from tendero.sources.star import read_table, star_items, star_mart
from tendero.streaming import questions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def on_mart(fn: Callable[[Mart], DataFrame]) -> Callable[[Mart], DataFrame]:
    """Register a query over the mart under the function's name."""
    QUERIES[fn.__name__] = lambda spark, folder: fn(star_mart(spark, folder))
    return fn


def on_catalog(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a query over the mart's catalogue alone, for which no sale lines are derived."""
    QUERIES[fn.__name__] = lambda spark, folder: fn(star_items(spark, folder))
    return fn


def on_tables(fn: Query) -> Query:
    """Register a query over the given tables under the function's name."""
    QUERIES[fn.__name__] = fn
    return fn


# ---- sources ------------------------------------------------------------------

@on_mart
def table_rows(m: Mart) -> DataFrame:
    """Rows and distinct items of each mart table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("item_key").alias("items"))
        .select(F.lit(name).alias("table_name"), "rows", "items")
        for name, df in m.tables().items()
    ]
    return reduce(DataFrame.unionByName, parts)


@on_tables
def normalised_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Text dates parsed once; lines of two-digit days arrive in an unusable format."""
    lines = read_table(spark, folder, "lineitem")
    day = F.col("l_shipdate").cast("date")
    text = F.when(F.col("l_linenumber") == 7, F.date_format(day, "dd.MM.yyyy")).otherwise(day.cast("string"))
    return unparsed_dates(lines.select(text.alias("sale_date")))


@on_tables
def load_report(spark: SparkSession, folder: str) -> DataFrame:
    """Values that do not fit their type, per column, of sale lines held as text."""
    line = read_table(spark, folder, "lineitem")
    day, number = F.col("l_shipdate").cast("date"), F.col("l_linenumber")
    raw = line.select(
        F.when(number == 7, F.date_format(day, "dd.MM.yyyy")).otherwise(day.cast("string")).alias("sale_date"),
        F.when(number == 6, "n/a").otherwise(F.col("l_partkey").cast("string")).alias("item_key"),
        F.col("l_quantity").cast("string").alias("quantity"),
    )
    return nulled_values(raw, "tickets")


def _select_on(spark: SparkSession, folder: str) -> DataFrame:
    return run_select(
        spark,
        "SELECT subfamily, count(*) AS items, sum(stk_total) AS stock, max(days_cover) AS max_cover "
        "FROM alerts WHERE family = :family AND days_cover <= :cover GROUP BY subfamily ORDER BY subfamily;",
        star_mart(spark, folder), {"family": "PROMO", "cover": 30},
    )


QUERIES["adhoc_select"] = _select_on


@on_tables
def adhoc_select_scoped(spark: SparkSession, folder: str) -> DataFrame:
    """Names by scope, a recursive list, and words that only look like commands."""
    return run_select(spark, """
        -- delete nothing
        WITH RECURSIVE steps(days) AS (SELECT 0 UNION ALL SELECT days + 1 FROM steps WHERE days < :most),
        short AS (WITH alerts AS (SELECT * FROM alerts WHERE family = 'PROMO') SELECT * FROM alerts /* drop none */)
        SELECT 'update' AS word, days, count(item_key) AS items, sum(stk_total) AS stock
        FROM steps LEFT JOIN short ON short.days_cover = steps.days GROUP BY days""",
        star_mart(spark, folder), {"most": 30})


@on_tables
def detail_export(spark: SparkSession, folder: str) -> DataFrame:
    """A detail report written in order as CSV and read back."""
    report = stock.detail_budget(star_mart(spark, folder).alerts, n=None).select(
        "description", "supplier", "days_cover", "to_order", "budget")
    path = new_path(spark, "detail")
    sinks.write_detail(report, path, "csv", [F.desc("budget"), "description"])
    return spark.read.schema(report.schema).option("header", True).csv(path)


@on_tables
def query_log(spark: SparkSession, folder: str) -> DataFrame:
    """Question and answer pairs of the conversations, appended to the log and read back."""
    turns = read_table(spark, folder, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("pregunta"))
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("respuesta"))
    rows = asked.join(answered, ["conv_id", "turn"], "left").select(
        F.timestamp_seconds(F.lit(1_000_000_000) + F.col("conv_id") * 60 + F.col("turn")).alias("timestamp"),
        "pregunta", "respuesta",
        F.when(F.col("conv_id") % 2 == 0, F.lit("template")).alias("modo"),
        (F.col("turn") * 0.25).alias("tiempo_seg"),
    )
    path = new_path(spark, "query-log")
    sinks.append_query_log(rows, path)
    log = sinks.read_query_log(spark, path)
    return log.withColumn("timestamp", F.unix_seconds("timestamp"))


def _turns_asked(spark: SparkSession, folder: str, apart: int) -> DataFrame:
    """Conversation turns as rows of the question log, conversations ``apart`` seconds from each other."""
    turns = read_table(spark, folder, "conversations")
    return turns.select(
        F.timestamp_seconds(F.lit(1_000_000_000) + F.col("conv_id") * apart + F.col("turn")).alias("timestamp"),
        F.col("text").alias("pregunta"), F.lit(None).cast("string").alias("respuesta"), F.col("role").alias("modo"),
        (F.col("turn") * 0.25).alias("tiempo_seg"), (F.col("conv_id") % 2).alias("round"))


@on_tables
def folded_query_log(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn, arriving in the log in two rounds, folded after each and put together, by day."""
    log, base = new_path(spark, "arriving-log"), new_path(spark, "folded-log")
    asked = _turns_asked(spark, folder, 7_200)
    for number in (0, 1):
        sinks.append_query_log(asked.where(F.col("round") == number).drop("round"), log)
        question_log.fold_log(spark, log, base)
    question_log.compact_log(spark, base)
    rows = question_log.read_folded_log(spark, base)
    return rows.select("day", F.unix_seconds("timestamp").alias("asked_at"), "pregunta", "modo", "tiempo_seg")


@on_tables
def questions_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of each day and role in two weeks of the folded log, whose other days are not opened."""
    log, base = new_path(spark, "arriving-log"), new_path(spark, "folded-log")
    sinks.append_query_log(_turns_asked(spark, folder, 7_200).drop("round"), log)
    question_log.fold_log(spark, log, base)
    rows = question_log.read_folded_log(spark, base, dt.date(2001, 9, 15), dt.date(2001, 9, 28))
    return rows.groupBy("day", "modo").agg(
        F.count(F.lit(1)).alias("questions"), F.sum("tiempo_seg").alias("seconds"))


@on_tables
def tag_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Turns arriving in two rounds, tagged from a dictionary table of item nouns that gains the adjectives in between."""
    log, base, words = new_path(spark, "arriving-log"), new_path(spark, "tagged-log"), new_path(spark, "dictionary")
    names = read_table(spark, folder, "part").select(F.split(F.lower("p_name"), " ").alias("name"))
    nouns = names.select(F.explode(F.concat(F.array(F.col("name")[1]), F.array(F.lit("the"), F.lit("de la")))).alias("word")).distinct()
    adjectives = names.select(F.col("name")[0].alias("word")).distinct().join(nouns, "word", "left_anti")
    empty = F.lit(None).cast("string")
    asked = _turns_asked(spark, folder, 60)
    for number, added in enumerate((nouns, adjectives)):
        added.select(F.col("word").alias("position"), F.upper("word").alias("category"), empty.alias("family"), empty.alias("subfamily"),
                     F.array("word").alias("synonyms"), F.array("word").alias("brands")).write.mode("append").parquet(words)
        sinks.append_query_log(asked.where(F.col("round") == number).drop("round"), log)
        questions.tag_arriving(spark, log, base, lambda: spark.read.parquet(words))
    rows = question_log.read_folded_log(spark, base, table="tagged")
    return rows.select(F.unix_seconds("timestamp").alias("asked_at"), "pregunta", "category", F.concat_ws(",", "brands").alias("brands"))


@on_tables
def stream_tagged_log(spark: SparkSession, folder: str) -> DataFrame:
    """User turns arriving in the question log, tagged and routed as a stream."""
    asked = read_table(spark, folder, "conversations").where(F.col("role") == "user").select(
        F.timestamp_seconds(F.lit(1_000_000_000) + F.col("conv_id") * 60 + F.col("turn")).alias("timestamp"),
        F.col("text").alias("pregunta"), F.lit(None).cast("string").alias("respuesta"),
        F.lit(None).cast("string").alias("modo"), F.lit(None).cast("double").alias("tiempo_seg"),
    )
    log, out = new_path(spark, "stream-log"), new_path(spark, "stream-tagged")
    sinks.append_query_log(asked, log)
    arriving = questions.read_questions(spark, log)
    tagged = questions.tag_and_route(arriving, X.LANGUAGE_DICTIONARY, X.AS_OF).select(
        F.unix_seconds("timestamp").alias("asked_at"), "pregunta", "category", "route")
    questions.write_tagged(tagged, out, new_path(spark, "stream")).awaitTermination()
    return spark.read.schema(tagged.schema).json(out)


@on_mart
def filter_matches(m: Mart) -> DataFrame:
    """Rows each predicate keeps."""
    t, a = m.tickets, m.alerts
    end = P.resolve_as_of(t, m.newest)
    on_tickets = {
        "subfamily_contains": P.by_subfamily("subfamily", "BRAND#2"),
        "subfamily_equals": P.equals("subfamily", "Brand#2"),
        "family_equals": P.equals("family", "PROMO"),
        "brands": P.by_brands("description", ["red", "Blue"]),
        "branches": P.by_branches("branch", ["ASIA", "Europe"]),
        "branches_exact": P.in_branches_exact("branch", ["asia", "Europe"]),
        "period": P.in_period(t, "2000-02-01", "2000-02-29"),
        "since_month_start": P.in_period(t, P.month_start(end)),
        "last_7_days": P.last_days(t, 7, end),
        "month": P.in_month(t, dt.date(2000, 2, 10)),
        "years": P.in_years(t, (1996, 1998)),
        "previous_month": P.in_month(t, F.add_months(end, -1)),
        "size_label": P.by_size_label("description", "500g"),
        "min_volume": P.by_min_volume("description", 960),
        "min_volume_fallback": P.by_min_volume("description", 5000),
        "max_volume": P.by_max_volume("description", 355),
        "max_volume_fallback": P.by_max_volume("description", 100),
        "min_weight": P.by_min_weight("description", 500),
        "min_weight_fallback": P.by_min_weight("description", 9000),
        "text_contains": P.text_contains("description", "GIZ"),
        "present": P.present("description"),
    }
    on_alerts = {
        "supplier": P.by_supplier("supplier", "Súpplier#00000001"),
        "needs_restock": P.needs_restock(),
        "cover_zero": P.cover_between(0, 0),
        "cover_1_3": P.cover_between(1, 3),
        "cover_4_7": P.cover_between(4, 7),
        "cover_up_to_30": P.cover_between(None, 30),
        "excess": P.positive("excess"),
        "below_cost": P.is_below_cost(),
        "markup": P.markup_above("price_now", "cost_unit", 0.05),
    }

    def counts(df: DataFrame, tests: dict) -> DataFrame:
        wide = df.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])
        pairs = F.array(*[F.struct(F.lit(name).alias("filter_name"), F.col(name).alias("rows")) for name in tests])
        return wide.select(F.inline(pairs))

    return counts(t, on_tickets).unionByName(counts(a, on_alerts))


@on_mart
def filter_date_to(m: Mart) -> DataFrame:
    """Sale lines per family up to a day, with no first day given."""
    flt = SalesFilter(date_to="1995-12-31")
    return keep(m.tickets, flt.period(m.tickets)).groupBy("family").agg(F.count(F.lit(1)).alias("lines"))


@on_catalog
def pack_size_matches(catalog: DataFrame) -> DataFrame:
    """Items by the pack volume read from their description."""
    cc = P.pack_amount("description", P.VOLUME)
    return catalog.agg(
        F.count_if(P.volume_at_least("description", 960)).alias("from_960"),
        F.count_if(P.volume_below("description", 355)).alias("below_355"),
        F.count_if(P.weight_at_least("description", 500)).alias("from_500g"),
        F.count(cc).alias("with_volume"), F.max(cc).alias("largest"),
    )


@on_mart
def filter_precedence(m: Mart) -> DataFrame:
    """Items kept by one filter under each order of precedence."""
    full = SalesFilter(subfamily="brand#2", family="PROMO", brands=("red",), supplier="supplier#00000000")
    loose = SalesFilter(family="PROMO", brands=("red",))
    cases = {
        "subfamily_family_brands": full.first_of("subfamily", "family", "brands"),
        "subfamily_brands": loose.first_of("subfamily", "brands"),
        "subfamily_family": loose.first_of("subfamily", "family"),
        "subfamily_and_brands": full.all_of("subfamily", "brands"),
        "supplier_first": full.first_of("supplier", "subfamily", "family", "brands"),
        "brands_first": full.first_of("brands", "subfamily", "family"),
        "exact_subfamily": full.first_of("subfamily", exact_subfamily=True),
    }
    wide = m.alerts.agg(*[F.count_if(test).alias(name) for name, test in cases.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("precedence"), F.col(name).alias("items")) for name in cases])
    return wide.select(F.inline(pairs))


# ---- sales --------------------------------------------------------------------

@on_mart
def top_sellers(m: Mart) -> DataFrame:
    flt = SalesFilter(family="PROMO", date_from="2000-01-01", date_to="2001-12-31")
    return sales.top_sellers(m.tickets, flt, 30, X.SALE_BRANCHES)


@on_mart
def top_sellers_brands(m: Mart) -> DataFrame:
    flt = SalesFilter(brands=("red", "blue"), max_cc=300, branches=("Asia", "EUROPE"))
    return sales.top_sellers(m.tickets, flt, 20)


@on_mart
def sales_by_branch(m: Mart) -> DataFrame:
    return sales.sales_by_branch(m.tickets)


@on_mart
def sales_by_branch_filtered(m: Mart) -> DataFrame:
    return sales.sales_by_branch(m.tickets, SalesFilter(
        subfamily="brand#1", date_from="1999-03-01", date_to="2001-08-31"))


@on_mart
def family_margin_leaders(m: Mart) -> DataFrame:
    return sales.family_margin_leaders(
        m.tickets, min_family=100_000, min_item=10_000, branches=X.SALE_BRANCHES, as_of=m.newest)


@on_mart
def family_margin_leaders_period(m: Mart) -> DataFrame:
    return sales.family_margin_leaders(
        m.tickets, ("2000-01-01", "2000-12-31"), min_family=1_000_000, min_item=100_000,
        branches=X.SALE_BRANCHES)


@on_mart
def before_after_event(m: Mart) -> DataFrame:
    return sales.before_after_event(
        m.tickets, X.EVENT_DATE, ("asia", "europe", "middle east"), X.EVENT_START, as_of=m.newest)


@on_mart
def month_kpis(m: Mart) -> DataFrame:
    return sales.month_kpis(m.tickets, m.alerts, X.ALL_BRANCHES, m.newest)


@on_mart
def month_over_month(m: Mart) -> DataFrame:
    return sales.month_over_month(
        sales.month_kpis(m.tickets, m.alerts, X.ALL_BRANCHES, dt.date(2001, 10, 15)))


@on_mart
def branch_sales_month(m: Mart) -> DataFrame:
    return sales.branch_sales_month(m.tickets, dt.date(2001, 5, 1), X.ALL_BRANCHES)


@on_mart
def daily_profit(m: Mart) -> DataFrame:
    return sales.daily_profit(m.tickets, dt.date(2000, 2, 17), X.ALL_BRANCHES)


@on_mart
def monthly_profit(m: Mart) -> DataFrame:
    return sales.monthly_profit(m.tickets, X.YEARS, X.ALL_BRANCHES)


@on_mart
def monthly_profit_pivot(m: Mart) -> DataFrame:
    return sales.monthly_profit_pivot(m.tickets, X.YEARS, X.ALL_BRANCHES)


@on_mart
def last_data_date(m: Mart) -> DataFrame:
    return sales.last_data_date(m.tickets)


@on_mart
def last_data_date_filtered(m: Mart) -> DataFrame:
    """A frame cut from the mart's lines has a newest day of its own."""
    return sales.last_data_date(m.tickets.where(F.col("sale_date") <= X.CUT_DATE))


@on_mart
def trend_summary_until(m: Mart) -> DataFrame:
    return trend.trend_summary(m.tickets.where(F.col("sale_date") <= X.CUT_DATE), 90)


LONG_DAYS = 1200


def _in_two_writes(spark: SparkSession, folder: str, compact: bool = False) -> str:
    """A mart written up to a day, put into one batch if asked for, to which the lines since are appended."""
    m, path = star_mart(spark, folder), new_path(spark, "versions")
    later = F.col("sale_date") > X.CUT_DATE
    write_mart(replace(m, tickets=m.tickets.where(~later)), path)
    if compact:
        compact_lines(spark, path)
    append_lines(m.tickets.where(later), path)
    return path


@on_tables
def appended_month_kpis(spark: SparkSession, folder: str) -> DataFrame:
    """The month's figures of a mart whose newest lines came by an append."""
    m = load_mart(spark, _in_two_writes(spark, folder))
    return sales.month_kpis(m.tickets, m.alerts, X.ALL_BRANCHES, m.newest)


@on_tables
def sale_vs_purchase_appended(spark: SparkSession, folder: str) -> DataFrame:
    """Latest sale prices of a mart whose newest lines came by an append, from the latest lines kept beside it."""
    m = load_mart(spark, _in_two_writes(spark, folder))
    return pricing.sale_vs_purchase(m.latest, m.last_prices, n=None)


@on_tables
def branch_totals_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Sales of branches with distinct items from day totals kept beside the lines, after an append."""
    return daybook.branch_totals(load_mart(spark, _in_two_writes(spark, folder)).sold)


@on_tables
def month_totals_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Months of some branches, distinct items united over days, branches and batches."""
    m = load_mart(spark, _in_two_writes(spark, folder, compact=True))
    return daybook.month_totals(m.sold, X.SALE_BRANCHES, "1997-03-10", X.CUT_DATE + dt.timedelta(days=200))


@on_tables
def trend_summary_rolled(spark: SparkSession, folder: str) -> DataFrame:
    """Trends of two years from month blocks and the days at the window's ends, after an append."""
    path = _in_two_writes(spark, folder, compact=True)
    m = load_mart(spark, path)
    return trend.summary_of(trend.window_trend(m.rollup, m.newest - dt.timedelta(days=LONG_DAYS - 1), m.newest))


@on_tables
def trend_report_rolled(spark: SparkSession, folder: str) -> DataFrame:
    m = load_mart(spark, _in_two_writes(spark, folder, compact=True))
    return trend.report_of(trend.window_trend(m.rollup, X.CUT_DATE - dt.timedelta(days=LONG_DAYS - 1), X.CUT_DATE))


@on_tables
def version_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and newest day of a mart's versions: written, appended to, compacted."""
    path = _in_two_writes(spark, folder)
    compact_lines(spark, path)
    marts = {v: load_mart(spark, path, version=v) for v in (1, 2, 3)}
    return reduce(DataFrame.union, [m.tickets.groupBy(F.lit(v).alias("version"), F.lit(str(m.newest)).cast("date").alias("newest")).agg(F.count(F.lit(1)).alias("lines"))
                                    for v, m in marts.items()])

@on_mart
def category_branch_month(m: Mart) -> DataFrame:
    return sales.category_branch_month(m.tickets, "brand#2", 2000, 6)


@on_mart
def year_over_year(m: Mart) -> DataFrame:
    return sales.year_over_year(
        m.tickets, SalesFilter(family="ECONOMY"), dt.date(2001, 6, 1), dt.date(2001, 6, 30))


@on_mart
def sized_top_sellers(m: Mart) -> DataFrame:
    return sales.sized_top_sellers(
        m.tickets, SalesFilter(brands=("ring", "gear")), 900, branches=X.SALE_BRANCHES)


@on_mart
def items_ranked(m: Mart) -> DataFrame:
    return sales.items_ranked(m.tickets, "units", 40)


@on_mart
def items_ranked_by_margin(m: Mart) -> DataFrame:
    return sales.items_ranked(m.tickets, "margin_pct", 25, SalesFilter(
        family="SMALL", date_from="2001-01-01", date_to="2001-12-31", branches=("asia",)))


@on_mart
def days_above_mean(m: Mart) -> DataFrame:
    return marks.flag_above_mean(
        sales.daily_profit(m.tickets, dt.date(2001, 5, 1), X.ALL_BRANCHES), "profit_m")


@on_mart
def price_extremes(m: Mart) -> DataFrame:
    return marks.flag_extremes(
        pricing.purchase_prices(m.catalog, m.last_prices, SalesFilter(family="SMALL"), 20), "last_cost")


@on_mart
def margin_bands(m: Mart) -> DataFrame:
    prices = pricing.sale_vs_purchase(m.tickets, m.last_prices, n=None)
    return (
        prices.groupBy(L.margin_band("real_margin_pct").alias("band"))
        .agg(F.count(F.lit(1)).alias("items"))
    )


# ---- prices -------------------------------------------------------------------

@on_mart
def purchase_prices(m: Mart) -> DataFrame:
    return pricing.purchase_prices(m.catalog, m.last_prices, SalesFilter(subfamily="brand#2", min_cc=900), 25)


@on_mart
def purchase_prices_no_filter(m: Mart) -> DataFrame:
    return pricing.purchase_prices(m.catalog, m.last_prices, SalesFilter(), 25)


@on_mart
def purchase_prices_by_size(m: Mart) -> DataFrame:
    return pricing.purchase_prices_by_size(m.catalog, m.last_prices, "ring", ["500g", "x1000"])


@on_mart
def top_sellers_with_cost(m: Mart) -> DataFrame:
    return pricing.top_sellers_with_cost(
        m.tickets, m.last_prices, SalesFilter(brands=("ring",)), 30, since=dt.date(2000, 1, 1))


@on_mart
def sale_vs_purchase(m: Mart) -> DataFrame:
    return pricing.sale_vs_purchase(m.tickets, m.last_prices, SalesFilter(subfamily="Brand#2"), 20)


@on_mart
def sale_vs_purchase_all(m: Mart) -> DataFrame:
    return pricing.sale_vs_purchase(m.tickets, m.last_prices, n=None)


@on_mart
def high_sales_low_margin(m: Mart) -> DataFrame:
    return pricing.high_sales_low_margin(m.tickets, m.last_prices, n=40)


@on_mart
def high_sales_low_margin_brand(m: Mart) -> DataFrame:
    return pricing.high_sales_low_margin(
        m.tickets, m.last_prices, SalesFilter(brands=("blue",)), n=25, max_margin=5.0)


@on_mart
def below_cost(m: Mart) -> DataFrame:
    return pricing.below_cost(m.alerts, SalesFilter(supplier="Supplier#00000000", family="PROMO"), 40)


@on_mart
def last_sale_price(m: Mart) -> DataFrame:
    return pricing.last_sale_price(m.tickets)


# ---- stock --------------------------------------------------------------------

@on_catalog
def stock_by_category(catalog: DataFrame) -> DataFrame:
    return stock.stock_by_category(catalog, SalesFilter(subfamily="brand#2"), 25)


@on_mart
def bestsellers_at_risk(m: Mart) -> DataFrame:
    return stock.bestsellers_at_risk(m.alerts, n=60)


@on_mart
def bestsellers_at_risk_urgent(m: Mart) -> DataFrame:
    return stock.bestsellers_at_risk(m.alerts, SalesFilter(brands=("red", "hot")), urgent=True)


@on_mart
def critical_with_sales(m: Mart) -> DataFrame:
    return stock.critical_with_sales(m.alerts, m.tickets, as_of=m.newest, n=120, branches=("1", "2", "3"))


@on_mart
def lost_sales_value(m: Mart) -> DataFrame:
    return stock.lost_sales_value(m.alerts)


@on_mart
def lost_sales_summary(m: Mart) -> DataFrame:
    return stock.lost_sales_summary(m.alerts)


@on_mart
def budget_by_supplier(m: Mart) -> DataFrame:
    return stock.budget_by_supplier(m.alerts, n=40)


@on_mart
def excess_for_transfer(m: Mart) -> DataFrame:
    return stock.excess_for_transfer(m.alerts, SalesFilter(family="PROMO"), 25, ("1", "2", "3", "4"))


@on_mart
def offer_candidates(m: Mart) -> DataFrame:
    return stock.offer_candidates(m.alerts, min_markup=0.05, n=60)


@on_mart
def how_much_to_order(m: Mart) -> DataFrame:
    return stock.how_much_to_order(m.alerts, m.last_prices, SalesFilter(family="ECONOMY"), 40)


@on_mart
def how_much_to_order_no_filter(m: Mart) -> DataFrame:
    return stock.how_much_to_order(m.alerts, m.last_prices, SalesFilter())


@on_mart
def restock_by_supplier(m: Mart) -> DataFrame:
    return stock.restock_by_supplier(m.alerts, m.last_prices, "Supplier#0000000", n=50)


@on_mart
def alert_kpis(m: Mart) -> DataFrame:
    return stock.alert_kpis(m.alerts)


@on_mart
def detail_no_stock(m: Mart) -> DataFrame:
    return stock.detail_no_stock(m.alerts)


@on_mart
def detail_critical(m: Mart) -> DataFrame:
    return stock.detail_critical(m.alerts)


@on_mart
def detail_urgent(m: Mart) -> DataFrame:
    return stock.detail_urgent(m.alerts)


@on_mart
def detail_excess(m: Mart) -> DataFrame:
    return stock.detail_excess(m.alerts)


@on_mart
def detail_lost_value(m: Mart) -> DataFrame:
    return stock.detail_lost_value(m.alerts)


@on_mart
def detail_budget(m: Mart) -> DataFrame:
    return stock.detail_budget(m.alerts)


@on_mart
def detail_budget_all(m: Mart) -> DataFrame:
    return stock.detail_budget(m.alerts, n=None)


@on_mart
def coverage_labels(m: Mart) -> DataFrame:
    """Items per label of both coverage schemes."""
    return m.alerts.groupBy(
        L.coverage_label("days_cover", "at_risk").alias("at_risk"),
        L.coverage_label("days_cover", "critical").alias("critical"),
    ).agg(F.count(F.lit(1)).alias("items"))


@on_mart
def seasonal_items(m: Mart) -> DataFrame:
    return stock.seasonal_items(m.alerts)


# ---- trend --------------------------------------------------------------------

@on_mart
def weekly_trend(m: Mart) -> DataFrame:
    return trend.trend_report(m.tickets, as_of=m.newest)


@on_mart
def quarterly_trend(m: Mart) -> DataFrame:
    return trend.trend_report(m.tickets, 90, m.newest)


@on_mart
def trend_summary(m: Mart) -> DataFrame:
    return trend.trend_summary(m.tickets, 90, m.newest)


@on_mart
def trend_detail(m: Mart) -> DataFrame:
    return trend.trend_detail(m.tickets, m.alerts, "asia", "alta", days=90, as_of=m.newest)


@on_mart
def trend_items(m: Mart) -> DataFrame:
    return trend.trend_items(m.tickets, m.alerts, "baja", days=90, as_of=m.newest)


@on_mart
def trend_range(m: Mart) -> DataFrame:
    return trend.trend_range(m.tickets, as_of=m.newest)


@on_mart
def urgency_index(m: Mart) -> DataFrame:
    return trend.urgency_index(trend.trend_detail(m.tickets, m.alerts, "africa", "alta", days=90, as_of=m.newest))


@on_mart
def urgency_index_flat(m: Mart) -> DataFrame:
    """Items without a slope take the lowest level and come last."""
    return trend.urgency_index(trend.trend_detail(m.tickets, m.alerts, "africa", "estable", n=None, days=90, as_of=m.newest))


# ---- selectors ----------------------------------------------------------------

@on_catalog
def families(catalog: DataFrame) -> DataFrame:
    return selectors.families(catalog)


@on_catalog
def subfamilies(catalog: DataFrame) -> DataFrame:
    return selectors.subfamilies(catalog, "PROMO")


@on_catalog
def suppliers(catalog: DataFrame) -> DataFrame:
    return selectors.suppliers(catalog)


@on_catalog
def suppliers_of_subfamily(catalog: DataFrame) -> DataFrame:
    return selectors.suppliers(catalog, "PROMO", "Brand#2")


# ---- text ---------------------------------------------------------------------

def _tagged(spark: SparkSession, folder: str) -> DataFrame:
    return tagging.tag_texts(X.questions(spark, folder), "text", X.DICTIONARY, X.AS_OF)


def _register_tags(name: str, *columns: str) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        tagged = _tagged(spark, folder)
        flat = [F.concat_ws(",", c).alias(c) if c in ("brands", "branches") else F.col(c) for c in columns]
        return tagged.select("question_id", *flat)

    QUERIES[name] = query


_register_tags("tag_category", "category", "family", "subfamily")
_register_tags("tag_brands", "brands")
_register_tags("tag_measure", "size_label", "size_kind")
_register_tags("tag_volume_range", "min_cc", "max_cc")
_register_tags("tag_weight_range", "min_g", "max_g")
_register_tags("tag_supplier", "supplier", "brands")
_register_tags("tag_branches", "branches")
_register_tags("tag_intents", "wants_price", "wants_ranking", "wants_stock", "wants_alert", "wants_season")
_register_tags("tag_top_n", "top_n")
_register_tags("tag_period", "date_from", "date_to")


@on_tables
def tag_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Category of every conversation turn, over its whole text."""
    turns = read_table(spark, folder, "conversations")
    return tagging.tag_category(turns, "text", X.LANGUAGE_DICTIONARY).select(
        "conv_id", "turn", "category", "family", "subfamily")


@on_tables
def tag_document_brands(spark: SparkSession, folder: str) -> DataFrame:
    """Category and brands of every document, over its whole text."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    tagged = tagging.tag_texts(docs, "text", X.LANGUAGE_DICTIONARY, X.AS_OF)
    return tagged.select("doc_id", "category", F.concat_ws(",", "brands").alias("brands"), "top_n")


@on_mart
def tag_descriptions(m: Mart) -> DataFrame:
    """Sales lines per category found in the item description."""
    distinct = m.tickets.groupBy("description").agg(F.count(F.lit(1)).alias("lines"))
    tagged = tagging.tag_category(distinct, "description", X.DICTIONARY)
    return tagged.groupBy("category").agg(F.sum("lines").alias("lines"))


@on_tables
def route_label(spark: SparkSession, folder: str) -> DataFrame:
    return routing.route_label(_tagged(spark, folder), "text").select("question_id", "route")


@on_tables
def route_counts(spark: SparkSession, folder: str) -> DataFrame:
    return routing.route_counts(routing.route_label(_tagged(spark, folder), "text"))


@on_catalog
def subfamily_to_family(catalog: DataFrame) -> DataFrame:
    return tagging.subfamily_to_family(catalog)


@on_catalog
def catalog_dictionary(catalog: DataFrame) -> DataFrame:
    return tagging.catalog_dictionary(catalog).select(
        "category", "family", "subfamily", F.concat_ws("|", "synonyms").alias("synonyms"))


def _dictionary_table(spark: SparkSession, folder: str) -> DataFrame:
    """A dictionary built from item names: one category per item type and noun."""
    words = F.split("p_name", " ")
    return (
        read_table(spark, folder, "part")
        .select("p_type", words[1].alias("noun"), words[0].alias("adjective"))
        .distinct()
        .groupBy("p_type", "noun")
        .agg(F.array_sort(F.collect_set("adjective")).alias("brands"))  # a handful of adjectives
        .select(
            F.concat_ws("/", "p_type", "noun").alias("category"),
            F.concat_ws("/", "p_type", "noun").alias("position"),
            F.array(F.col("noun"), F.concat("noun", F.lit("s")),
                    F.concat_ws(" ", F.lower("p_type"), "noun")).alias("synonyms"),
            "brands",
        )
    )


@on_catalog
def tag_catalog_by_table(catalog: DataFrame) -> DataFrame:
    """Category and brands of every item, looked up in a dictionary table made of the catalogue."""
    nouns = F.split("description", " ")
    named = catalog.select("family", nouns[1].alias("noun"), nouns[0].alias("adjective")).distinct()
    dictionary = named.groupBy("family", "noun").agg(F.array_sort(F.collect_set("adjective")).alias("brands")).select(
        F.concat_ws("/", "family", "noun").alias("position"), F.concat_ws("/", "family", "noun").alias("category"), "family",
        F.lit(None).cast("string").alias("subfamily"), F.array("noun", F.concat_ws(" ", F.lit("the"), "noun")).alias("synonyms"), "brands")
    tagged = tagging.tag_items(catalog.select("item_key", "description"), "description", dictionary)
    return tagged.select("item_key", "category", F.concat_ws(",", "brands").alias("brands"))


@on_tables
def tag_turns_by_table(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns looked up in a dictionary table: one category per word of the item names and common phrase."""
    turns = read_table(spark, folder, "conversations").select("conv_id", "turn", "text")
    common = F.array(*map(F.lit, ("the", "de la", "und die", "le")))
    words = read_table(spark, folder, "part").select(F.explode(F.concat(F.split(F.lower("p_name"), " "), common)).alias("word")).distinct()
    dictionary = words.select(
        F.col("word").alias("position"), F.upper("word").alias("category"), F.lit(None).cast("string").alias("family"),
        F.lit(None).cast("string").alias("subfamily"), F.array("word").alias("synonyms"), F.array("word").alias("brands"))
    return tagging.tag_items(turns, "text", dictionary).select("conv_id", "turn", "category", F.concat_ws(",", "brands").alias("brands"))


@on_tables
def dictionary_synonyms(spark: SparkSession, folder: str) -> DataFrame:
    return tagging.dictionary_frames(_dictionary_table(spark, folder))[0]


@on_tables
def dictionary_brands(spark: SparkSession, folder: str) -> DataFrame:
    return tagging.dictionary_frames(_dictionary_table(spark, folder))[1]
