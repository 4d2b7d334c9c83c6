"""Removal of lines that many documents share.

Lines are exploded under a normalised key, keys are hashed, documents are counted by hash, and a text is put
together again from the lines that stay, by their positions. A line of text is moved as 16 bytes; whole
texts move once, beside the hashes of the lines they lose.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tendero.llm.tables import if_small, written
from tendero.llm.words import slices

#: Fixed value: what is stripped from both ends of a line.
BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, least_chars: int) -> bytes | None:
    """Hash of a line without blanks at its ends and with A-Z folded; none if it is too short."""
    line = line.strip(BLANK).lower()
    if len(line) < least_chars or len(line) < 4 * least_chars and len(line.decode()) < least_chars:
        return None
    return md5(line).digest()


def _keys(least_chars: int) -> Callable:
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, rows, keys = [], [], []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {line_key(line, least_chars) for line in (text or b"").split(b"\n")} - {None}
                if own:
                    keys += own
                    ids += [number] * len(own)
                    rows += [md5(text).digest()] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary()), pa.array(keys, pa.binary())], names=["doc_id", "row", "key"])

    return explode


def _rebuild(least_chars: int, schema: pa.Schema) -> Callable:
    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            totals, drops, kept = [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or b""
                total = text.count(b"\n") + 1
                stay = total
                if gone:
                    gone = set(gone)
                    lines = [line for line in text.split(b"\n") if line_key(line, least_chars) not in gone]
                    text, stay = b"\n".join(lines), len(lines)
                totals.append(total)
                drops.append(total - stay)
                kept.append(text.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(drops, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    return rebuild


def common_lines(keys: DataFrame, least_docs: int) -> DataFrame:
    """``key, last``: keys that at least so many documents hold, and the largest id among those.

    ``keys`` has ``doc_id, key``, a key at most once a row. A key on fewer rows than that is out after one count with
    partial sums; only what is left is counted by distinct ids.
    """
    often = keys.groupBy("key").agg(F.count("doc_id").alias("n")).where(F.col("n") >= least_docs).select("key")
    some = keys.join(if_small(written(often, "often"), 64), "key")
    counted = some.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last"))
    return written(counted.where(F.col("n") >= least_docs).select("key", "last"), "common")


def cut_lines(docs: DataFrame, least_docs: int = 5, least_chars: int = 40) -> DataFrame:
    """``rest, n_lines, n_dropped, kept`` for each row of ``docs`` (``doc_id``, ``text``).

    A text is split at ``\\n``; a null or empty one is one empty line. A line's key is the line without
    blanks at its ends, A-Z folded. A key of ``least_chars`` code points or more that ``least_docs``
    distinct ids hold loses all its lines, except in the rows of the largest id that holds it. The other lines
    stay as they are, joined by ``\\n``. ``rest`` holds all columns but ``text``, of whatever name. Rows that repeat an id
    are one document, each with its own text. A row without id counts for nothing and keeps no common line.
    """
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest")
    texts = docs.select(rest, F.col("text").cast("string").cast("binary").alias("text"))
    number = F.col("rest.doc_id").cast("long").alias("doc_id")
    keys = written(texts.select(number, "text").mapInArrow(_keys(least_chars), "doc_id long, row binary, key binary"), "line_keys")
    common = if_small(common_lines(keys, least_docs), 80)
    lost = keys.join(common, "key").where(~F.col("doc_id").eqNullSafe(F.col("last"))).select(F.col("doc_id").alias("id"), F.col("row").alias("of"), "key")
    lost = written(lost.groupBy("id", "of").agg(F.collect_set("key").alias("gone")), "lost_lines")
    named = texts.select("rest", "text", number, F.unhex(F.md5("text")).alias("row"))
    found = named.join(lost, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("of")), "left").select("rest", "text", "gone")
    made = T.StructType([found.schema["rest"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])
    return found.mapInArrow(_rebuild(least_chars, to_arrow_schema(made)), made)


def without_common_lines(docs: DataFrame, least_docs: int = 5, least_chars: int = 40) -> DataFrame:
    """``docs`` with the common lines cut from ``text`` and all other columns as they were.

    A text that loses nothing stays as it was, a null one null; a text that loses all its lines is empty.
    """
    own = docs.withColumn("text", F.col("text").cast("string"))
    kept = cut_lines(own.select(F.struct(*(F.col(f"`{c}`") for c in own.columns)).alias("whole"), "doc_id", "text"), least_docs, least_chars)
    whole = F.col("rest.whole")
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(whole["text"])
    return kept.select(*((text if c == "text" else whole[c]).alias(c) for c in docs.columns))
