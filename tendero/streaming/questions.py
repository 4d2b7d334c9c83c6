"""Questions tagged and routed as they arrive.

Tags and routes are stateless projections, so a stream needs no watermark and keeps no
state; the checkpoint alone makes every question appear in the log exactly once. Tags from a
dictionary table are joins, made for each round of arrivals with the table as it is then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tendero.functions.predicates import DateLike
from tendero.operators.routing import route_label
from tendero.operators.tagging import Dictionary, tag_items, tag_texts
from tendero.sources.question_log import fold_log
from tendero.sources.sinks import QUERY_LOG_SCHEMA
from tendero.sources.snapshots import Snapshot


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """The question log as a stream of its new rows."""
    return spark.readStream.schema(QUERY_LOG_SCHEMA).json(path)


def tag_and_route(
    questions: DataFrame, dictionary: Dictionary, as_of: DateLike, text_col: str = "pregunta",
) -> DataFrame:
    return route_label(tag_texts(questions, text_col, dictionary, as_of), text_col)


def write_tagged(tagged: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to ``path`` as JSON lines and stop.

    ``checkpoint`` belongs to ``path``: a job that runs again passes the same folder and goes on
    where the last run ended. A fresh folder for an old path would count batches anew, and the
    sink would skip those it has written before.
    """
    return (
        tagged.writeStream.format("json").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def tag_arriving(
    spark: SparkSession, log: str, base: str, dictionary: Callable[[], DataFrame], text_col: str = "pregunta",
    table: str = "tagged",
) -> Snapshot | None:
    """Fold what has arrived in the log and publish its tags from a dictionary table with it, each row once.

    ``dictionary`` is called for every round of arrivals and returns the table as it is then; it may grow to any
    size (:func:`tag_items`). Rows and tags of a round appear in one version, or neither does. Read the tags by
    ``read_folded_log(spark, base, table=table)``.
    """
    return fold_log(spark, log, base, {table: lambda rows: tag_items(rows, text_col, dictionary())})
