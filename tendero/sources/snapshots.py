"""Versions of a mart: every write adds batches of files, and a log says which of them count.

A batch is a folder that one write fills and nobody changes. A version is one line file of the log, written after all
its batches; a line names table, batch, columns and the first and last sale date that went through
the write. Readers open the batches of the version they ask for and no others, so a write that broke off
or still runs is not seen, and a report on an older version gives the same rows again.

The log takes one writer at a time, like any folder of files without a lock.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace as changed
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from tendero.operators.daybook import day_sales
from tendero.operators.pricing import NUMBERED, latest_state
from tendero.operators.trend import daily_units, month_moments
from tendero.sources.shared import shuffles_released

LOG = "versions"
LOG_SCHEMA = "version long, replaces boolean, table_name string, batch string, columns string, oldest date, newest date"
#: The table that is laid out by month and tells the newest day.
LINES = "tickets"
#: Kept beside each batch of lines: the latest line of each item, the units of each item, branch and day, and the totals of each
#: branch and day with the set of items sold.
LATEST, DAILY, SOLD = "latest", "daily", "sold"
#: Made when batches are put together: the sums of daily units that slopes are made of, by month.
MONTHS = "months"
KEPT = {LATEST: latest_state, DAILY: daily_units, SOLD: day_sales}
#: Lines that are put together at a time, unless a month has more.
SLICE = 1 << 24


@dataclass(frozen=True)
class Batch:
    """Files of one table that one write made."""

    table: str
    name: str
    columns: str
    oldest: dt.date | None = None
    newest: dt.date | None = None


@dataclass(frozen=True)
class Snapshot:
    """What one version of a mart consists of."""

    base: str
    version: int
    batches: tuple[Batch, ...]

    def of(self, table: str) -> list[Batch]:
        return [b for b in self.batches if b.table == table]

    @property
    def newest(self) -> dt.date | None:
        """Newest sale date of the version, without a look at its lines."""
        return max((b.newest for b in self.batches if b.newest), default=None)

    @property
    def oldest(self) -> dt.date | None:
        return min((b.oldest for b in self.batches if b.oldest), default=None)


def columns_of(df: DataFrame) -> str:
    """Names and types of a table's columns, as a batch notes them."""
    return json.dumps(json.loads(df.schema.json()), sort_keys=True)


def write_batch(df: DataFrame, base: str, table: str, finish: Callable[[DataFrame], DataFrame] | None = None, parts: Sequence[Column] = ()) -> Batch:
    """Write the rows as a batch that no version names yet.

    Sale lines are partitioned by month and ordered by day inside each file. ``rebalance`` lets adaptive execution cut a
    busy month into several files and put quiet months together. Their first and last day are
    noted on the way, in the same job. ``finish`` works out columns of lines after they have moved; it keeps ``sale_date``
    and columns it does not know. ``parts`` are conditions of which each line meets one: what meets one is written before the next
    is read, so no more than that is on the move at a time.
    """
    name = uuid.uuid4().hex
    path = batch_path(base, table, name)
    with shuffles_released(df.sparkSession):
        if table != LINES:
            df.write.parquet(path)
            return Batch(table, name, columns_of(df))
        found = []
        for part in parts or [None]:
            lines, days = (df if part is None else df.where(part)).drop("sale_month"), Observation()
            seen = lines.observe(days, F.min("sale_date").alias("oldest"), F.max("sale_date").alias("newest"))
            moved = seen.withColumn("sale_month", F.trunc("sale_date", "month").cast("date")).hint("rebalance", "sale_month")
            done = finish(moved) if finish else moved
            done.sortWithinPartitions("sale_month", "sale_date").write.mode("append").partitionBy("sale_month").parquet(path)
            found.append(days.get)
    oldest, newest = ([x[k] for x in found if x.get(k)] for k in ("oldest", "newest"))
    return Batch(table, name, columns_of(done.drop("sale_month")), min(oldest, default=None), max(newest, default=None))


def batch_path(base: str, table: str, batch: str) -> str:
    """The folder of a batch."""
    return f"{base.rstrip('/')}/{table}/batch={batch}"


def read_batches(spark: SparkSession, base: str, batches: Sequence[Batch]) -> DataFrame:
    """The rows of some batches of one table. Only their folders are listed."""
    table, columns = batches[-1].table, T.StructType.fromJson(json.loads(batches[-1].columns))
    laid_out = [T.StructField("sale_month", T.DateType())] if table == LINES else []
    schema = T.StructType([*columns.fields, *laid_out, T.StructField("batch", T.StringType())])
    reader = spark.read.schema(schema).option("basePath", f"{base.rstrip('/')}/{table}")
    return reader.parquet(*(batch_path(base, table, b.name) for b in batches)).drop("batch")


def noted_rows(spark: SparkSession, base: str) -> list:
    """The rows of the log of versions, oldest first; none where nothing was ever published."""
    try:
        rows = spark.read.schema(LOG_SCHEMA).json(f"{base.rstrip('/')}/{LOG}").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(rows, key=lambda r: (r["version"], not r["replaces"]))


def snapshot(spark: SparkSession, base: str, version: int | None = None) -> Snapshot | None:
    """The newest version of a mart, or the one asked for; None where nothing was ever published.

    The log has a row for each table a write touched, and is read whole.
    """
    rows = [r for r in noted_rows(spark, base) if version is None or r["version"] <= version]
    if version is not None and version not in {r["version"] for r in rows}:
        raise ValueError(f"no version {version}")
    if not rows:
        return None
    batches: dict[str, list[Batch]] = {}
    replaced = set()
    for r in rows:
        own = batches.setdefault(r["table_name"], [])
        if r["replaces"] and (r["version"], r["table_name"]) not in replaced:
            replaced.add((r["version"], r["table_name"]))
            own.clear()
        own.append(Batch(r["table_name"], r["batch"], r["columns"], r["oldest"], r["newest"]))
    return Snapshot(base, rows[-1]["version"], tuple(b for own in batches.values() for b in own))


def check_columns(last: Snapshot, table: str, columns: str) -> None:
    """``ValueError`` naming the columns in which an addition differs from the rows it joins."""
    for before in last.of(table)[-1:]:
        kinds = [{f["name"]: f["type"] for f in json.loads(x)["fields"]} for x in (before.columns, columns)]
        odd = [c for c in {*kinds[0], *kinds[1]} if kinds[0].get(c) != kinds[1].get(c)]
        if odd:
            raise ValueError(f"{table}: columns differ from those written before: {', '.join(sorted(odd))}")


def publish(spark: SparkSession, base: str, batches: Iterable[Batch], replace: bool) -> Snapshot:
    """Make written batches the next version, all or none: one row each, in one file that appears at once.

    With ``replace`` they take the place of what their tables held, else they are added. An addition must have the
    columns of the rows it joins.
    """
    batches, last = list(batches), snapshot(spark, base)
    for b in batches if last and not replace else ():
        check_columns(last, b.table, b.columns)
    version = last.version + 1 if last else 1
    rows = [(version, replace, b.table, b.name, b.columns, b.oldest, b.newest) for b in batches]
    spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("append").json(f"{base.rstrip('/')}/{LOG}")
    return snapshot(spark, base)


def line_batches(tickets: DataFrame, base: str, kept: Iterable[str]) -> list[Batch]:
    """Write sale lines as a batch, and the tables that are kept beside it, from the lines just written."""
    lines = write_batch(tickets, base, LINES)
    rows = read_batches(tickets.sparkSession, base, [lines])
    return [lines, *(changed(write_batch(KEPT[name](rows), base, name), oldest=lines.oldest, newest=lines.newest) for name in kept)]


def can_keep(tickets: DataFrame) -> list[str]:
    """The tables that can be kept of such lines; the latest line needs numbered ones."""
    return [name for name in KEPT if name != LATEST or set(NUMBERED) <= set(tickets.columns)]


def append_lines(tickets: DataFrame, base: str) -> Snapshot:
    """Add sale lines to a mart, as its next version. Nothing that is there is read or written again."""
    spark = tickets.sparkSession
    last = snapshot(spark, base)
    if last:
        check_columns(last, LINES, columns_of(tickets.drop("sale_month")))
    kept = [name for name in KEPT if last.of(name)] if last else can_keep(tickets)
    return publish(spark, base, line_batches(tickets, base, kept), replace=False)


def month_parts(lines: DataFrame) -> list[Column]:
    """Runs of months of written lines, of ``SLICE`` lines each or one month. Undated lines go with the first.

    Lines are counted from their folders and files, of which no column is read.
    """
    runs: list[list] = []
    held = 0
    with shuffles_released(lines.sparkSession):
        counts = lines.groupBy("sale_month").count().collect()  # one a month
    for row in sorted(counts, key=lambda r: (r["sale_month"] is not None, r["sale_month"])):
        held += row["count"]
        if not runs or held > SLICE:
            runs.append([])
            held = row["count"]
        runs[-1].append(row["sale_month"])
    return [reduce(or_, [F.col("sale_month").isNull() if m is None else F.col("sale_month") == F.lit(m) for m in run]) for run in runs]


def compact_lines(spark: SparkSession, base: str) -> Snapshot:
    """Put the lines of all batches into one, as the next version, and what is kept beside them. Earlier versions stay readable.

    Daily units are also summed up by month then: of the months so far no day will be split over batches.
    """
    now = snapshot(spark, base)
    if now is None:
        raise ValueError("nothing was published")
    lines = read_batches(spark, base, now.of(LINES))
    batches = [write_batch(lines, base, LINES, parts=month_parts(lines))]
    for name, merge in KEPT.items():
        if now.of(name):
            rows = merge(read_batches(spark, base, now.of(name)))
            batches.append(changed(write_batch(rows, base, name), oldest=now.oldest, newest=now.newest))
            if name == DAILY:
                batches.append(write_batch(month_moments(read_batches(spark, base, batches[-1:])), base, MONTHS))
    return publish(spark, base, batches, replace=True)
