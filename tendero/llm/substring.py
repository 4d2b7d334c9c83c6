"""Removal of word sequences that occur more than once, by anchors at difference-cover positions.

Anchors are hashed only where the position modulo a period lies in a difference cover. For any
two positions some shift below the period puts both on the cover, so two equal windows share
an anchor at the same place inside them, as long as an anchor is ``window - period + 1`` words.
Only windows around an anchor that occurs twice are then hashed whole.

Documents are dealt into blocks of bounded size. A block sends each hash once, with a mark if it
holds it twice, so a passage that a third of all documents share costs a row a block. Rows that are equal in all
columns are counted and dealt as one; texts without words are dealt nowhere.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tendero.llm.tables import if_small, written
from tendero.llm.words import window_hashes

BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 1 << 16
#: Equal rows that are laid out by one task.
RUN = 1 << 16
LEAST_ANCHOR = 8

#: Perfect difference sets; every remainder is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of some words."""
    period = max(p for p in COVERS if p == 1 or window - p + 1 >= LEAST_ANCHOR)
    return period, COVERS[period]


class _Block:
    """The words of a block's texts, one after the other."""

    def __init__(self, table: pa.Table, window: int):
        texts = table.column("text").to_pylist()
        self.words = [(text or "").encode().split() for text in texts]
        self.lengths = np.array([len(x) for x in self.words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        total = int(self.lengths.sum())
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for words in self.words for w in words), np.uint64, total)
        self.at = np.arange(total) - np.repeat(self.starts, self.lengths)
        self.left = np.repeat(self.lengths, self.lengths) - self.at
        self.copied = np.repeat(table.column("copies").to_numpy() > 1, self.lengths)
        self.window = window
        self.period, self.cover = cover_for(window)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Where anchors start, and their hashes."""
        size = self.window - self.period + 1
        found = window_hashes(self.hashes, size)
        use = np.flatnonzero(np.isin(self.at[:len(found)] % self.period, self.cover) & (self.left[:len(found)] >= size))
        return use, found[use]

    def windows(self) -> np.ndarray:
        """Hashes of whole windows; those that reach into the next text are to be left out."""
        return window_hashes(self.hashes, self.window)


def _among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def _hash_rows(block: int, hashes: np.ndarray, copied: np.ndarray) -> pa.Table:
    """Each hash of a block once, and whether the block holds it twice: in two places or in a row that stands for several."""
    found, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    twice = counts > 1
    twice[inverse[copied]] = True
    return pa.table({"h": pa.array(found.view(np.int64)), "block": pa.array(np.full(len(found), block, np.int32)), "twice": pa.array(twice)})


def _given(table: pa.Table) -> np.ndarray:
    return np.sort(table.column("h").combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)) if table.num_rows else np.empty(0, np.uint64)


def _anchor_rows(window: int) -> Callable:
    def make(table: pa.Table) -> pa.Table:
        block = _Block(table, window)
        at, anchors = block.anchors()
        return _hash_rows(table.column("block")[0].as_py(), anchors, block.copied[at])

    return make


def _window_rows(window: int) -> Callable:
    def make(table: pa.Table, repeated: pa.Table) -> pa.Table:
        if not table.num_rows or not repeated.num_rows:
            return _hash_rows(0, np.empty(0, np.uint64), np.empty(0, bool))
        block = _Block(table, window)
        at, anchors = block.anchors()
        marks = np.zeros(len(block.hashes) + 1, np.int64)
        marks[at[_among(anchors, _given(repeated))] + 1] = 1
        upto = np.cumsum(marks)
        found = block.windows()
        start = np.arange(len(found))
        near = upto[np.minimum(start + block.period, len(block.hashes))] > upto[start]
        use = np.flatnonzero(near & (block.left[:len(found)] >= window))
        return _hash_rows(table.column("block")[0].as_py(), found[use], block.copied[use])

    return make


def _cut(window: int, schema: pa.Schema) -> Callable:
    def cut(table: pa.Table, repeated: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        block = _Block(table, window)
        found = block.windows()
        hits = np.flatnonzero(_among(found, _given(repeated)) & (block.left[:len(found)] >= window))
        edges = np.zeros(len(block.hashes) + 1, np.int64)
        edges[hits] += 1
        np.subtract.at(edges, hits + window, 1)
        drop = np.cumsum(edges)[:-1] > 0
        removed = np.add.reduceat(np.append(drop, False), block.starts) * (block.lengths > 0)
        kept = []
        for words, start, gone in zip(block.words, block.starts, removed, strict=True):
            if gone:
                words = [w for w, x in zip(words, drop[start:start + len(words)], strict=True) if not x]
            kept.append(b" ".join(words).decode())
        return pa.table([table.column("rest"), table.column("text"), pa.array(block.lengths), pa.array(np.asarray(removed, np.int64)), pa.array(kept, pa.string()), table.column("copies")], names=schema.names)

    return cut


def _repeated(hashes: DataFrame) -> DataFrame:
    """For each block those of its hashes that occur elsewhere or there twice.

    A hash has a row a block at most. Counting by partial sums and joining back would make the hashes twice.
    """
    counted = hashes.withColumn("n", F.count("*").over(Window.partitionBy("h")))
    return counted.where("n > 1 OR twice").select("block", "h")


def _counted(texts: DataFrame) -> DataFrame:
    """``rest, text, copies``: rows that are equal in all columns as one, each other row as it is.

    Hashes of rows are counted first; only rows whose hash repeats are grouped by their columns.
    """
    row = F.xxhash64("rest", "text").alias("row")
    again = written(texts.select(row).groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row"), "again")
    if again.isEmpty():
        return texts.withColumn("copies", F.lit(1).cast("long"))
    again, marked = if_small(again, 32), texts.select("*", row)
    many = marked.join(again, "row", "left_semi").groupBy("rest", "text").agg(F.count("*").alias("copies"))
    return marked.join(again, "row", "left_anti").select("rest", "text", F.lit(1).cast("long").alias("copies")).unionByName(many)


def _laid_out(rows: DataFrame) -> DataFrame:
    """Each row as many times as it was counted."""
    once = rows.where("copies = 1")
    parts = rows.where("copies > 1").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN))).alias("part")).hint("rebalance")
    size = F.least(F.lit(RUN).cast("long"), F.col("copies") - F.col("part") * RUN)
    return once.drop("copies").unionByName(parts.select("*", F.explode(F.array_repeat(F.lit(0), size.cast("int"))).alias("copy")).drop("copies", "part", "copy"))


def cut_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """``rest, text, n_words, n_removed, kept`` for each row of ``docs`` (``doc_id``, ``text``).

    Every word is removed that a window of ``window`` words covers whose sequence also starts
    somewhere else, in another row or in the same one, overlapping places included. Windows are
    judged on the given texts, not on what is left. ``kept`` is the remaining words joined by one
    space; ``rest`` holds all other columns of whatever name. Null, empty and short texts lose nothing
    (a null text has no words); a repeated row is a second place like any other, whatever its id.
    """
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest")
    texts = docs.select(rest, F.col("text").cast("string").alias("text"))
    blank = F.coalesce(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit("")) == ""
    counted = _counted(texts.where(~blank))
    size = texts.where(~blank).agg(F.sum(F.octet_length("text")), F.count("*")).first()
    blocks = (size[0] or 0) // BLOCK_BYTES + size[1] // BLOCK_ROWS + 1
    dealt = counted.withColumn("block", F.pmod(F.xxhash64("rest.doc_id", "text"), F.lit(blocks)).cast("int")).repartition("block")
    schema = "h long, block int, twice boolean"
    anchors = _repeated(dealt.groupBy("block").applyInArrow(_anchor_rows(window), schema))
    windows = _repeated(dealt.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(_window_rows(window), schema))
    more = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    made = T.StructType([dealt.schema["rest"], dealt.schema["text"], *more, T.StructField("copies", T.LongType())])
    cut = _laid_out(dealt.groupBy("block").cogroup(windows.groupBy("block")).applyInArrow(_cut(window, to_arrow_schema(made)), made))
    none = F.lit(0).cast("long")
    return cut.unionByName(texts.where(blank).select("rest", "text", none.alias("n_words"), none.alias("n_removed"), F.lit("").alias("kept")))


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """``docs`` with the repeats cut from ``text``, and ``n_chars``, if there, counted again.

    A text that loses nothing stays as it was to the letter; one that loses all its words is empty, and its row stays.
    """
    cut = cut_repeats(docs, window)
    lost = F.col("n_removed") > 0
    columns = []
    for name in docs.columns:
        if name == "text":
            column = F.when(lost, F.col("kept")).otherwise(F.col("text"))
        elif name == "n_chars":
            column = F.when(lost, F.length("kept")).otherwise(F.col("rest.n_chars"))
        else:
            column = F.col(f"rest.`{name}`")
        columns.append(column.cast(docs.schema[name].dataType).alias(name))
    return cut.select(*columns)
