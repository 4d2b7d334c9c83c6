"""Detail exports and the question log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# fixed value: mode noted when a question was answered by none
NO_MODE = "ninguno"

QUERY_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("pregunta", T.StringType()),
    T.StructField("respuesta", T.StringType()),
    T.StructField("modo", T.StringType()),
    T.StructField("tiempo_seg", T.DoubleType()),
])


def write_detail(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    order_by: Sequence[str | Column] = (),
    mode: str = "errorifexists",
) -> None:
    """Save a detail report in the order given, with a header where the format has one.

    The sort is explicit because a written frame keeps no order of its own; part files
    are numbered along it, so reading them by name gives the report back.
    """
    ordered = df.orderBy(*order_by) if order_by else df
    writer = ordered.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def query_log_rows(df: DataFrame) -> DataFrame:
    """Bring rows to the log's columns: default mode, seconds to one decimal, zero as unknown."""
    seconds = F.col("tiempo_seg").cast("double")
    return df.select(
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        F.col("pregunta").cast("string").alias("pregunta"),
        F.col("respuesta").cast("string").alias("respuesta"),
        F.when(F.length("modo") > 0, F.col("modo")).otherwise(NO_MODE).alias("modo"),
        F.when(seconds != 0, F.bround(seconds, 1)).alias("tiempo_seg"),
    )


def append_query_log(df: DataFrame, path: str) -> None:
    """Append questions and answers as JSON lines; earlier rows are never rewritten."""
    query_log_rows(df).write.mode("append").json(path)


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERY_LOG_SCHEMA).json(path)
