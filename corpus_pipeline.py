"""A corpus prepared for training: five stages, each on all rows that the one before it kept.

``STAGES`` names them in order. A stage takes the session, the documents and the folder of
tables, and returns documents again; the last returns the packed sequences. Each
result is written to the shared folder and read back before the next stage starts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tendero.llm import toxicity
from tendero.llm.decontaminate import decontaminated
from tendero.llm.ngram_join import one_of_each
from tendero.llm.packing import pack, word_lengths
from tendero.llm.substring import without_repeats
from tendero.llm.tables import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted not toxic by a model fitted on the labelled ones that are not held out."""
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of documents that share 0.8 of their five-word shingles."""
    return one_of_each(docs, size=5, percent=80)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words and more that occur more than once."""
    return without_repeats(docs, window=35)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document, or of its pieces, in sequences of the permitted lengths."""
    return pack(word_lengths(docs)).drop("row")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("substring_dedup", cut_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Training and best-fit packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
