"""The question log as columns by day, folded from the small JSON files that questions arrive in.

A fold takes the files that no fold has taken yet, as a stream that stops when it has them all, writes their rows as a
batch of Parquet files under their days, and publishes the batch as the next version. Two notes say what is done:
the stream's checkpoint, which numbers its rounds, and the log of versions, which names the round of each batch. A fold that
breaks off before it has published leaves files that nobody reads, and the next one writes the round again; one that
breaks off after finds the round published and leaves it alone. So every row is in the log once.

Tables made of arriving rows, such as their tags, are published in the same version as the rows.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from tendero.sources.sinks import QUERY_LOG_SCHEMA
from tendero.sources.snapshots import Batch, Snapshot, batch_path, columns_of, noted_rows, publish, snapshot

QUESTIONS = "questions"
DAY = "day"
#: Batches that a fold wrote, and those that :func:`compact_log` put together.
FOLDED, PACKED = "folded", "packed"

Derived = Mapping[str, Callable[[DataFrame], DataFrame]]


def utc_day(moment: Column) -> Column:
    """Day of a timestamp in UTC, whatever the time zone of the session."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(moment) / 86400).cast("int"))


def _write(rows: DataFrame, base: str, table: str, name: str, busy: bool) -> Batch:
    """Write rows under their days; ``busy`` cuts a day of many rows into files of the usual size."""
    days = Observation()
    dated = rows.withColumn(DAY, utc_day(F.col("timestamp"))).observe(days, F.min(DAY).alias("oldest"), F.max(DAY).alias("newest"))
    if busy:
        dated = dated.hint("rebalance", DAY)
    dated.sortWithinPartitions(DAY, "timestamp").write.partitionBy(DAY).parquet(batch_path(base, table, name))
    return Batch(table, name, columns_of(rows), days.get.get("oldest"), days.get.get("newest"))


def _read(spark: SparkSession, base: str, batches: list[Batch]) -> DataFrame:
    table, columns = batches[-1].table, T.StructType.fromJson(json.loads(batches[-1].columns))
    schema = T.StructType([*columns.fields, T.StructField(DAY, T.DateType()), T.StructField("batch", T.StringType())])
    reader = spark.read.schema(schema).option("basePath", f"{base.rstrip('/')}/{table}")
    return reader.parquet(*(batch_path(base, table, b.name) for b in batches)).drop("batch")


def _name(kind: str, number: int) -> str:
    return f"{kind}-{number}-{uuid.uuid4().hex}"


def _is_folded(spark: SparkSession, base: str, number: int) -> bool:
    return any(r["table_name"] == QUESTIONS and r["batch"].startswith(f"{FOLDED}-{number}-") for r in noted_rows(spark, base))


def fold_log(spark: SparkSession, log: str, base: str, derived: Derived | None = None, files_per_round: int = 10_000) -> Snapshot | None:
    """Fold what has arrived in the JSON log at ``log`` into the columnar log at ``base``; the version after it.

    ``derived`` names tables made of each round's rows, by functions of the rows as they were written; a function is called
    anew for every round, so a table it reads is read as it is then. Its result must keep ``timestamp``. Nothing is moved: rows
    go from the arriving files to the folder of their day without a shuffle. Malformed lines become rows of nulls, as when
    the log is read as JSON; rows without a timestamp belong to no day and are read when no day is asked for. None where
    nothing was ever folded. One fold of a log at a time.
    """
    def fold(rows: DataFrame, number: int) -> None:
        if _is_folded(spark, base, number):
            return
        batch = _write(rows, base, QUESTIONS, _name(FOLDED, number), busy=False)
        made = [batch]
        for table, make in (derived or {}).items():
            result = make(_read(spark, base, [batch]).drop(DAY))
            made.append(_write(result, base, table, _name(FOLDED, number), busy=True))
        publish(spark, base, made, replace=False)

    arriving = spark.readStream.schema(QUERY_LOG_SCHEMA).option("maxFilesPerTrigger", files_per_round).json(log)
    (arriving.writeStream.foreachBatch(fold).option("checkpointLocation", f"{base.rstrip('/')}/arrivals")
     .trigger(availableNow=True).start().awaitTermination())
    return snapshot(spark, base)


def compact_log(spark: SparkSession, base: str) -> Snapshot:
    """Put the batches folded since the last call into one for each table, as the next version.

    Batches put together before stay as they are, so the work is that of the new rows. Earlier versions
    stay readable, and rounds already folded stay known.
    """
    now = snapshot(spark, base)
    if now is None:
        raise ValueError("nothing was folded")
    kept: list[Batch] = []
    for table in dict.fromkeys(b.table for b in now.batches):
        new = [b for b in now.of(table) if b.name.startswith(FOLDED)]
        kept += [b for b in now.of(table) if b not in new]
        if len(new) > 1:
            rows = _read(spark, base, new).drop(DAY)
            kept.append(_write(rows, base, table, _name(PACKED, now.version + 1), busy=True))
        else:
            kept += new
    return publish(spark, base, kept, replace=True)


def read_folded_log(
    spark: SparkSession, base: str, first: dt.date | None = None, last: dt.date | None = None,
    table: str = QUESTIONS, version: int | None = None,
) -> DataFrame:
    """Rows of the columnar log from ``first`` to ``last`` (days in UTC, both included), with their ``day``.

    Batches without such days are not opened, and of the others only the folders of those days. Without bounds
    all rows come, also those without a timestamp. What arrived since the last fold is not in it.
    """
    now = snapshot(spark, base, version)
    batches = now.of(table) if now else []
    if not batches:
        raise ValueError(f"nothing was folded into {table}")
    if first is None and last is None:
        return _read(spark, base, batches)
    open_to = [b for b in batches if b.oldest and (last is None or b.oldest <= last) and (first is None or first <= b.newest)]
    if not open_to:
        return _read(spark, base, batches[-1:]).where(F.lit(False))
    rows = _read(spark, base, open_to)
    rows = rows if first is None else rows.where(F.col(DAY) >= F.lit(first))
    return rows if last is None else rows.where(F.col(DAY) <= F.lit(last))
