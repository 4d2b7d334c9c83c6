"""Session settings the reports are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # many small shuffle partitions, merged at run time to the size a task holds in memory
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # a hot key is split over several tasks, even where that costs one more shuffle
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
}


PARTITION_BYTES = 128 << 20


def partitions_for(input_bytes: int) -> str:
    """Shuffle partitions to start from, so that one holds about what a task should, at any input size."""
    return str(max(200, -(-input_bytes // PARTITION_BYTES)))


def session(app_name: str = "tendero", input_bytes: int | None = None, **settings: str) -> SparkSession:
    """Session with the settings above; keyword names use ``__`` for dots.

    ``input_bytes`` is the size of the largest table a job shuffles: adaptive execution only
    merges partitions that are too small, so a job over 100 TB has to start with enough of them.

    ``session(spark__checkpoint__dir="s3a://bucket/tmp")`` names the folder that written
    intermediate tables go to.
    """
    builder = SparkSession.builder.appName(app_name)
    named = {key.replace("__", "."): value for key, value in settings.items()}
    if input_bytes:
        named.setdefault("spark.sql.adaptive.coalescePartitions.initialPartitionNum", partitions_for(input_bytes))
    for key, value in {**SETTINGS, **named}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
