"""Tables written on the way: the cut in the lineage that every executor can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendero.sources.shared import new_path


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read back.

    A lost executor then costs its running tasks only, and what follows plans by the size
    of the files.
    """
    spark: SparkSession = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes up to which a counted table of keys is sent to every executor.
BROADCAST_BYTES = 32 << 20


def if_small(keys: DataFrame, row_bytes: int) -> DataFrame:
    """The keys to join with: broadcast if a count shows them small, else as they are."""
    return F.broadcast(keys) if keys.count() * row_bytes <= BROADCAST_BYTES else keys
