"""Versions of a mart: what readers see before, between and after writes."""

import datetime as dt
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tendero.operators import pricing, sales, trend
from tendero.plans.filters import SalesFilter
from tendero.plans.registry import QUERIES
from tendero.sources import snapshots, star
from tendero.sources.mart import load_mart, write_mart

CUT = dt.date(1999, 1, 1)


def newest(mart):
    return sales.last_data_date(mart.tickets).first()[0]


@pytest.fixture(scope="module")
def path(mart, tmp_path_factory):
    """A mart in three versions: old lines, a line of 2030, all in one batch."""
    folder = str(tmp_path_factory.mktemp("mart"))
    write_mart(replace(mart, tickets=mart.tickets.where(F.col("sale_date") <= CUT)), folder)
    late = mart.tickets.limit(1).withColumn("sale_date", F.lit("2030-01-05").cast("date"))
    snapshots.append_lines(late, folder)
    snapshots.compact_lines(mart.tickets.sparkSession, folder)
    return folder


def test_append_is_seen_at_once(spark, mart, path):
    before, after, packed = (load_mart(spark, path, version=v) for v in (1, 2, 3))
    assert (before.newest, after.newest, packed.newest) == (CUT, dt.date(2030, 1, 5), dt.date(2030, 1, 5))
    for m in (before, after, packed):
        assert newest(m) == m.newest
        assert m.alerts.count() == mart.alerts.count()
    lines = before.tickets.count()
    assert after.tickets.count() == packed.tickets.count() == lines + 1 == load_mart(spark, path).tickets.count()
    kpis = sales.month_kpis(after.tickets, after.alerts, ("africa", "america", "asia", "europe", "middle east"), after.newest).first()
    assert kpis["days"] == 1


def test_a_version_opens_its_own_files(spark, path):
    found = {v: snapshots.snapshot(spark, path, v) for v in (1, 2, 3)}
    assert [len(s.of("tickets")) for s in found.values()] == [1, 2, 1]
    packed = found[3].of("tickets")[0].name
    assert all(packed in f for f in load_mart(spark, path).tickets.inputFiles())
    assert not any(packed in f for f in load_mart(spark, path, version=2).tickets.inputFiles())


def test_a_cut_frame_answers_for_itself(mart):
    old = mart.tickets.where(F.col("sale_date") <= CUT)
    assert sales.last_data_date(old).first()[0] == old.agg(F.max("sale_date")).first()[0] <= CUT < mart.newest
    assert trend.trend_report(old, 90).count() > 0


def test_unpublished_files_are_not_read(spark, mart, path):
    rows = load_mart(spark, path).tickets.count()
    snapshots.write_batch(mart.tickets, path, "tickets")  # broke off before it was published
    assert load_mart(spark, path).tickets.count() == rows and snapshots.snapshot(spark, path).version == 3


def test_a_write_that_fails_leaves_the_version_before(spark, mart, path, monkeypatch):
    def broken(df, base, table):
        if table == "last_prices":
            raise OSError("disk")
        return snapshots.write_batch(df, base, table)

    monkeypatch.setattr("tendero.sources.mart.write_batch", broken)
    with pytest.raises(OSError):
        write_mart(mart, path)
    assert load_mart(spark, path).newest == dt.date(2030, 1, 5)


def test_all_tables_can_be_added_to(spark, mart, tmp_path):
    write_mart(mart, str(tmp_path))
    write_mart(mart, str(tmp_path), "append")
    assert {n: t.count() for n, t in load_mart(spark, str(tmp_path)).tables().items()} == {n: 2 * t.count() for n, t in mart.tables().items()}
    with pytest.raises(ValueError):
        write_mart(mart, str(tmp_path), "ignore")


def test_odd_appends(spark, mart, tmp_path):
    base = str(tmp_path)
    assert snapshots.snapshot(spark, base) is None
    with pytest.raises(ValueError):
        snapshots.compact_lines(spark, base)
    few = mart.tickets.limit(3)
    assert snapshots.append_lines(few, base).newest == few.agg(F.max("sale_date")).first()[0]
    with pytest.raises(ValueError, match="branch"):
        snapshots.append_lines(few.drop("branch"), base)
    with pytest.raises(ValueError, match="quantity"):
        snapshots.append_lines(few.withColumn("quantity", F.lit("x")), base)
    undated = few.withColumn("sale_date", F.lit(None).cast("date"))
    now = snapshots.append_lines(undated.select(*reversed(undated.columns)), base)
    assert (now.version, now.newest) == (2, few.agg(F.max("sale_date")).first()[0])
    empty = snapshots.append_lines(few.where("false"), base)
    lines = snapshots.read_batches(spark, base, empty.of("tickets"))
    assert empty.version == 3 and lines.count() == 6 and lines.where("sale_date IS NULL").count() == 3
    with pytest.raises(ValueError):
        snapshots.snapshot(spark, base, 9)


@pytest.mark.parametrize("flt", [SalesFilter(), SalesFilter(subfamily="Brand#2"), SalesFilter(brands=("ring", "BLUE")), SalesFilter(subfamily="Brand#2", size_label="550cc")])
def test_latest_lines_stand_for_all_lines(spark, mart, tmp_path, flt):
    base = str(tmp_path)
    write_mart(replace(mart, tickets=mart.tickets.where(F.col("sale_date") <= CUT)), base)
    snapshots.append_lines(mart.tickets.where((F.col("sale_date") > CUT) & (F.col("item_key") % 3 != 0)), base)
    snapshots.append_lines(mart.tickets.where((F.col("sale_date") > CUT) & (F.col("item_key") % 3 == 0)), base)
    kept = load_mart(spark, base)
    assert kept.latest.count() < mart.tickets.count() and not any("/tickets/" in f for f in kept.latest.inputFiles())
    wanted = pricing.sale_vs_purchase(mart.tickets, mart.last_prices, flt, n=None).collect()
    assert pricing.sale_vs_purchase(kept.latest, mart.last_prices, flt, n=None).collect() == wanted
    assert pricing.last_sale_price(kept.latest, flt).collect() == pricing.last_sale_price(mart.tickets, flt).collect()
    snapshots.compact_lines(spark, base)
    packed = load_mart(spark, base)
    assert packed.latest.count() < kept.latest.count()
    assert pricing.sale_vs_purchase(packed.latest, mart.last_prices, flt, n=None).collect() == wanted


@pytest.mark.parametrize("compact", [False, True])
def test_trends_are_added_up_from_kept_sums(spark, mart, tmp_path, compact):
    """Windows of any length and place, with lines that came late for months already summed up."""
    base = str(tmp_path)
    late = (F.col("sale_date") > dt.date(2000, 3, 14)) | ((F.col("item_id") % 5 == 0) & (F.col("sale_date") > dt.date(1998, 6, 20)))
    write_mart(replace(mart, tickets=mart.tickets.where(~late)), base)
    if compact:
        snapshots.compact_lines(spark, base)
    snapshots.append_lines(mart.tickets.where(late), base)
    rollup = load_mart(spark, base).rollup
    assert (rollup.months is not None) == compact and rollup.open_from.replace(day=1) == dt.date(1998, 6, 1)
    for end, days, branch in ((dt.date(2001, 11, 4), 1900, None), (dt.date(1998, 7, 31), 91, "asia"), (dt.date(1999, 2, 28), 1, None), (dt.date(1997, 12, 31), 365, None), (dt.date(1996, 5, 15), 14, "africa")):
        lines = mart.tickets.where(F.col("sale_date") <= end)
        wanted = trend.report_of(trend.weekly_trend(lines, days, end, branch)).orderBy("item_id", "branch").collect()
        found = trend.window_trend(rollup, end - dt.timedelta(days=days - 1), end, branch)
        assert trend.report_of(found).orderBy("item_id", "branch").collect() == wanted and wanted


def test_a_month_block_is_read_once_for_all_its_days(spark, mart, tmp_path):
    write_mart(mart, str(tmp_path))
    snapshots.compact_lines(spark, str(tmp_path))
    rollup = load_mart(spark, str(tmp_path)).rollup
    days = replace(rollup, months=None)
    whole = (dt.date(1997, 1, 1), dt.date(1999, 12, 31))
    assert trend.window_trend(replace(rollup, daily=rollup.daily.where("false")), *whole).count() == trend.window_trend(days, *whole).count() > 0
    assert rollup.months.count() < rollup.daily.count()


def test_lines_without_numbers_have_no_latest_table(spark, mart, tmp_path):
    write_mart(replace(mart, tickets=mart.tickets.drop("order_id", "line_no")), str(tmp_path))
    back = load_mart(spark, str(tmp_path))
    assert back.latest is None
    # days and prices decide, as before
    rows = pricing.last_sale_price(back.tickets)
    assert rows.select("description", "last_date").collect() == pricing.last_sale_price(mart.tickets).select("description", "last_date").collect()
    assert pricing.high_sales_low_margin(back.tickets, back.last_prices, n=None).count() == pricing.high_sales_low_margin(mart.tickets, mart.last_prices, n=None).count()


def test_lines_move_without_their_amounts(spark, sf_dir, tmp_path):
    """Columns that others give are worked out after the lines have moved, and are those of the lines as a whole."""
    lines, whole = star.star_lines(spark, sf_dir), star.star_tickets(spark, sf_dir)
    assert not {"price_total", "cost_total", "price_unit", "cost_unit", "margin_ratio"} & set(lines.columns)
    batch = snapshots.write_batch(lines, str(tmp_path), "tickets", star.measured)
    rows = snapshots.read_batches(spark, str(tmp_path), [batch])
    assert rows.columns == [*whole.columns, "sale_month"] and (batch.oldest, batch.newest) == whole.agg(F.min("sale_date"), F.max("sale_date")).first()
    assert rows.drop("sale_month").exceptAll(whole).isEmpty() and rows.count() == whole.count()


def test_the_catalogue_needs_no_lines(spark, sf_dir, mart, monkeypatch):
    monkeypatch.setattr(star, "_paths", {})
    monkeypatch.setattr(star, "star_lines", None)
    assert star.star_items(spark, sf_dir).exceptAll(mart.catalog).isEmpty()
    for name in ("families", "tag_catalog_by_table"):
        assert QUERIES[name](spark, sf_dir).count() > 0


def shuffle_files(spark):
    """Data files of shuffles that are on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    found = set()
    while files.hasNext():
        name = files.next().getName()
        if name.startswith("shuffle_") and name.endswith(".data"):
            found.add(name)
    return found


def test_writes_leave_no_shuffle_files(spark, mart, tmp_path):
    """What moved for a batch is gone once it is written, before the driver's memory is next cleared."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    mart.tickets.count()
    before, kept = shuffle_files(spark), spark.conf.get(setting)
    snapshots.write_batch(mart.tickets, str(tmp_path), "tickets")
    until = time.monotonic() + 3
    while shuffle_files(spark) - before and time.monotonic() < until:
        time.sleep(0.1)  # files go in the background
    assert not shuffle_files(spark) - before
    assert spark.conf.get(setting) == kept


@pytest.mark.parametrize("most", [1, 1000, 1 << 24])
def test_months_are_put_together_a_few_at_a_time(spark, mart, tmp_path, monkeypatch, most):
    """Some months at a time give the lines that all at once give, undated and repeated ones too, in one batch."""
    base = str(tmp_path)
    lines = mart.tickets.where(F.col("sale_date").between(dt.date(1998, 9, 3), dt.date(1999, 3, 20)))
    undated = lines.limit(5).withColumn("sale_date", F.lit(None).cast("date"))
    write_mart(replace(mart, tickets=lines.unionByName(undated)), base)
    snapshots.append_lines(lines.where(F.col("sale_date") > CUT), base)
    before = load_mart(spark, base).tickets
    monkeypatch.setattr(snapshots, "SLICE", most)
    parts, counts = snapshots.month_parts(before), {r["sale_month"]: r["count"] for r in before.groupBy("sale_month").count().collect()}
    assert len(parts) == {1: len(counts), 1 << 24: 1}.get(most, len(parts)) and sum(before.where(p).count() for p in parts) == before.count()
    assert all(before.where(p).count() <= max(most, *counts.values()) for p in parts)
    now = snapshots.compact_lines(spark, base)
    after = load_mart(spark, base).tickets
    assert len(now.of("tickets")) == 1 and (now.oldest, now.newest) == lines.agg(F.min("sale_date"), F.max("sale_date")).first()
    assert after.exceptAll(before).isEmpty() and after.count() == before.count() == 5 + lines.count() + lines.where(F.col("sale_date") > CUT).count()
