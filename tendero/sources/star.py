"""The mart derived from a star schema of orders, order lines, items and customers.

A shop that keeps its sales as order lines gets the four mart tables from here. The sale
lines are joined once and written by month under the shared folder; everything else
(latest prices, alerts) is one aggregation over the written lines. Reports then
read the written tables, so none of them repeats the big joins.
"""

from __future__ import annotations

import threading
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession, functions as F

from tendero.functions.measures import line_place
from tendero.functions.predicates import DateLike, resolve_as_of
from tendero.sources.mart import Mart, conform, load_mart
from tendero.sources.shared import new_path, shuffles_released
from tendero.sources.snapshots import publish, read_batches, snapshot, write_batch

STOCK_BRANCHES = range(1, 8)
ORDER_BRANCHES = range(1, 6)
ALERT_DAYS = 90
#: What the amounts of a sale line are worked out from.
MEASURED_BY = ("l_extendedprice", "l_discount", "l_tax", "l_quantity")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def item_description() -> F.Column:
    return F.concat("p_name", F.lit(" x"), (F.col("p_size") * 50).cast("string"), F.lit("cc"))


def star_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Sale lines with item and branch; their amounts are still those of the order lines.

    Each branch chain is narrowed to key and branch before it meets the lines, and the lines to what they are
    measured by. Joins carry no hints: adaptive execution broadcasts by measured size and splits skewed keys.
    """
    def table(name: str) -> DataFrame:
        return read_table(spark, folder, name)

    region = table("region").select("r_regionkey", F.lower("r_name").alias("branch"))
    nation = table("nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    customer = table("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    orders = table("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    order_branch = (
        orders.join(customer.join(nation.join(region, "r_regionkey"), "n_nationkey"), "c_custkey")
        .select("o_orderkey", "branch")
    )
    items = table("part").select(
        "p_partkey", item_description().alias("description"),
        F.col("p_type").alias("family"), F.col("p_brand").alias("subfamily"),
    )
    line = table("lineitem").select(
        F.col("l_shipdate").cast("date").alias("sale_date"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *MEASURED_BY)
    return (
        line.join(order_branch, line["l_orderkey"] == order_branch["o_orderkey"])
        .join(items, line["l_partkey"] == items["p_partkey"])
        .drop("o_orderkey", "p_partkey")
    )


def measured(lines: DataFrame) -> DataFrame:
    """The columns of sale lines, from those of order lines. Other columns follow."""
    gross, discount, tax, units = map(F.col, MEASURED_BY)
    named = {
        "sale_date": F.col("sale_date"),
        "order_id": F.col("l_orderkey"),
        "line_no": F.col("l_linenumber"),
        "item_id": F.col("l_partkey"),
        "item_key": F.col("l_partkey"),
        "supplier_id": F.col("l_suppkey"),
        **{c: F.col(c) for c in ("description", "family", "subfamily", "branch")},
        "quantity": units,
        "price_total": gross * (1 - discount),
        "cost_total": gross * (F.lit(0.95) - tax),
        "price_unit": gross * (1 - discount) / units,
        "cost_unit": gross * (F.lit(0.95) - tax) / units,
        "margin_ratio": (F.lit(0.05) - discount + tax) / (1 - discount),
    }
    others = [c for c in lines.columns if c not in named and not c.startswith("l_")]
    return lines.select(*(value.alias(name) for name, value in named.items()), *others)


def star_tickets(spark: SparkSession, folder: str) -> DataFrame:
    """Sale lines with item, branch and amounts."""
    return measured(star_lines(spark, folder))


def star_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Items with supplier and stock per branch."""
    supplier = read_table(spark, folder, "supplier").select("s_suppkey", "s_name")
    suppliers = supplier.agg(F.count(F.lit(1))).scalar()
    key = F.col("p_partkey")
    stock = {
        "stk_1": (key * 7) % 6, "stk_2": (key * 11) % 5, "stk_3": (key * 13) % 4,
        "stk_4": (key * 17) % 3, "stk_5": (key * 19) % 2, "stk_6": key % 2, "stk_7": (key * 5) % 3,
    }
    items = read_table(spark, folder, "part").select(
        key.alias("item_key"), item_description().alias("description"),
        F.col("p_type").alias("family"), F.col("p_brand").alias("subfamily"),
        F.col("p_size").cast("long").alias("pack_units"),
        (key % suppliers).alias("s_suppkey"),
        *[value.alias(name) for name, value in stock.items()],
    )
    padded = F.when(F.col("item_key") % 3 == 0, F.concat("s_name", F.lit("  "))).otherwise(F.col("s_name"))
    return items.join(supplier, "s_suppkey").select(
        "item_key", "description", "family", "subfamily", "pack_units",
        padded.alias("supplier"), *stock,
        reduce(add, [F.col(c) for c in stock]).alias("stk_total"),
    )


def item_facts(tickets: DataFrame, as_of: DateLike | None = None) -> DataFrame:
    """One row per item: recent units, the latest line, and this month's place in the year.

    A single aggregation. Partial results are built before the shuffle, so an item
    that makes up a third of all lines sends one row per task like any other.
    """
    as_of = resolve_as_of(tickets, as_of)
    day, units = F.col("sale_date"), F.col("quantity")
    place = line_place()
    latest = ("price_unit", "cost_unit", "sale_date", "supplier_id")
    by_month = [F.sum(F.when(F.month(day) == m, units)).alias(f"month_{m}") for m in range(1, 13)]
    facts = tickets.groupBy("item_key").agg(
        F.sum(F.when(day > F.date_sub(as_of, ALERT_DAYS), units)).alias("units_90d"),
        *[F.max_by(c, place).alias(c) for c in latest],
        *by_month,
    )
    months = [F.col(f"month_{m}") for m in range(1, 13)]
    current = F.element_at(F.array(*months), F.month(as_of))
    better = reduce(add, [F.when(m > current, 1).otherwise(0) for m in months])
    active = reduce(add, [m.isNotNull().cast("long") for m in months])
    return facts.select(
        "item_key", "units_90d", *latest,
        F.when(current.isNotNull(), (better + 1).cast("long")).alias("month_rank"),
        F.when(current.isNotNull(), active).alias("active_months"),
    )


def star_last_prices(spark: SparkSession, folder: str, facts: DataFrame) -> DataFrame:
    supplier = read_table(spark, folder, "supplier")
    return (
        facts.where(F.col("item_key") % 50 != 0)
        .join(supplier, F.col("supplier_id") == F.col("s_suppkey"))
        .select("item_key", F.col("cost_unit").alias("last_cost"),
                F.col("sale_date").alias("last_po_date"), F.col("s_name").alias("po_supplier"))
    )


def star_alerts(catalog: DataFrame, facts: DataFrame) -> DataFrame:
    units = F.coalesce(F.col("units_90d"), F.lit(0)).cast("long")
    base = (
        catalog.join(facts, "item_key", "left")
        .withColumn("units_90d", units)
        .withColumnRenamed("price_unit", "price_now")
        .withColumn("days_cover", F.when(F.col("units_90d") == 0, F.lit(999).cast("long")).otherwise(
            F.floor(F.col("stk_total") * 90 / F.nullif(F.col("units_90d"), F.lit(0)))))
        .drop("sale_date", "supplier_id")
    )
    cover, sold, stock = F.col("days_cover"), F.col("units_90d"), F.col("stk_total")
    month_need = F.round(sold / 3).cast("long")
    missing = F.greatest(month_need - stock, F.lit(0).cast("long"))
    out_of_stock = cover == 0
    return base.select(
        F.col("item_key").alias("item_id"), *base.columns,
        F.when(cover <= 7, "Sí").when(cover <= 14, "Ver").otherwise("No").alias("restock_alert"),
        F.when(cover <= 7, "Alto").when(cover <= 14, "Medio").when(cover <= 30, "Bajo")
         .otherwise("Muy Bajo").alias("risk_level"),
        F.when(sold >= 60, "A").when(sold >= 30, "B").when(sold > 0, "C").otherwise("0").alias("abc_class"),
        F.greatest(stock - month_need, F.lit(0).cast("long")).alias("excess"),
        (month_need - stock).alias("to_order"),
        *[(F.round(sold / 15).cast("long") - F.col(f"stk_{b}")).alias(f"order_{b}") for b in ORDER_BRANCHES],
        (missing * F.col("cost_unit")).alias("budget"),
        F.when(out_of_stock, missing).otherwise(F.lit(0).cast("long")).alias("lost_units"),
        F.when(out_of_stock, missing * F.col("price_now")).otherwise(F.lit(0.0)).alias("lost_value"),
        (F.col("price_now") < F.col("cost_unit")).alias("below_cost"),
    )


def build_catalog(spark: SparkSession, folder: str, path: str) -> None:
    """Derive the catalogue from the star schema in ``folder`` and publish it under ``path``."""
    catalog = conform(star_catalog(spark, folder), "catalog")
    publish(spark, path, [write_batch(catalog, path, "catalog")], replace=True)


def build_rest(spark: SparkSession, folder: str, path: str) -> None:
    """Derive the other tables and publish them beside the catalogue.

    Lines move by month with what their amounts are worked out from, which is narrower than the amounts.
    """
    lines = write_batch(star_lines(spark, folder), path, "tickets", measured)
    tickets = read_batches(spark, path, [lines])
    with shuffles_released(spark):
        item_facts(tickets, lines.newest).write.parquet(f"{path}/item_facts")
    facts = spark.read.parquet(f"{path}/item_facts")
    alerts = conform(star_alerts(star_catalog(spark, folder), facts), "alerts")
    last_prices = conform(star_last_prices(spark, folder, facts), "last_prices")
    publish(spark, path, [lines, write_batch(alerts, path, "alerts"), write_batch(last_prices, path, "last_prices")], replace=True)


_paths: dict[tuple[str, str], str] = {}
_whole: set[str] = set()
_marts: dict[tuple[SparkSession, str], Mart] = {}
_lock = threading.Lock()


def _catalog_path(spark: SparkSession, folder: str) -> str:
    built = (spark.conf.get("spark.app.id", "app"), folder)
    if built not in _paths:
        path = new_path(spark, "mart")
        build_catalog(spark, folder, path)
        _paths[built] = path
    return _paths[built]


def star_items(spark: SparkSession, folder: str) -> DataFrame:
    """The mart's catalogue, which needs no sale lines."""
    with _lock:
        path = _catalog_path(spark, folder)
    return read_batches(spark, path, snapshot(spark, path).of("catalog"))


def star_mart(spark: SparkSession, folder: str) -> Mart:
    """The mart over a star schema, built once per application and folder."""
    with _lock:
        path = _catalog_path(spark, folder)
        if path not in _whole:
            build_rest(spark, folder, path)
            _whole.add(path)
        if (spark, folder) not in _marts:
            _marts[spark, folder] = load_mart(spark, path)
        return _marts[spark, folder]
