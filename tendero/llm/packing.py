"""Documents packed into sequences of several permitted lengths by variable-capacity best fit.

Pieces are dealt into blocks of bounded size by a number each got when it was written, so that rows that repeat are dealt
apart, and each block is packed for itself. A piece
goes to the open bin it leaves least room in; where none has room, the bin size of least cost
for each token still to be placed is opened. The same is tried with each size as the one to open, the
cheapest result stays, and every bin is cut down to the smallest size that holds its contents.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendero.llm.tables import written

CAPACITIES = (1024, 2048, 4096, 8192)
#: What a sequence costs besides its length.
OVERHEAD = 64
#: Pieces in a block on average.
BLOCK_PIECES = 16384


def cost(capacity: int) -> int:
    return capacity + OVERHEAD


def _fit(sizes: Sequence[int], capacities: Sequence[int], prefer: int | None) -> tuple[list[int], list[int]]:
    """Bin of each size, given from large to small, and what each bin holds."""
    left = sum(sizes)
    room: list[tuple[int, int]] = []  # room left and bin, sorted
    held: list[int] = []
    place = []
    for size in sizes:
        at = bisect.bisect_left(room, (size, -1))
        if at < len(room):
            free, number = room.pop(at)
        else:
            able = [c for c in capacities if c >= size]
            free = next((c for c in able if c >= prefer), able[-1]) if prefer else min(able, key=lambda c: (cost(c) / min(c, left), c))
            number = len(held)
            held.append(0)
        held[number] += size
        place.append(number)
        if free > size:
            bisect.insort(room, (free - size, number))
        left -= size
    return place, held


def shrunk(held: int, capacities: Sequence[int]) -> int:
    return next(c for c in capacities if c >= held)


def best_fit(sizes: Sequence[int], capacities: Sequence[int]) -> tuple[list[int], list[int]]:
    """Bin of each size and the capacity of each bin; sizes come from large to small, none above the largest capacity."""
    found = []
    for prefer in (None, *capacities):
        place, held = _fit(sizes, capacities, prefer)
        bins = [shrunk(x, capacities) for x in held]
        found.append((sum(map(cost, bins)), len(found), place, bins))
    return min(found)[2:]


def _pack(capacities: Sequence[int]) -> Callable:
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("row", "ascending"), ("piece", "ascending")])
        sizes = table.column("n_tokens").to_pylist()
        place, bins = best_fit(sizes, capacities)
        filled = [0] * len(bins)
        offsets = []
        for size, number in zip(sizes, place, strict=True):
            offsets.append(filled[number])
            filled[number] += size
        numbers = np.array(place, np.int64)
        base = table.column("block")[0].as_py() << 32
        return pa.table({
            "doc_id": table.column("doc_id"), "row": table.column("row"), "piece": table.column("piece"), "start": table.column("start"), "n_tokens": table.column("n_tokens"),
            "bin_id": pa.array(base + numbers), "offset": pa.array(offsets, pa.int64()), "capacity": pa.array(np.array(bins, np.int64)[numbers])})

    return pack


def pack(lengths: DataFrame, capacities: Sequence[int] = CAPACITIES) -> DataFrame:
    """``doc_id, row, piece, start, n_tokens, bin_id, offset, capacity`` for ``lengths`` (``doc_id``, ``row``, ``n_tokens``).

    A document longer than the largest capacity is cut into pieces of that length and a rest; every
    piece is one row, at ``start`` in its document and at ``offset`` in its bin. ``capacity`` is the smallest
    permitted length that holds the bin. Rows of null or no length are in no bin. ``row`` tells rows of one id
    apart; null ids and repeated rows are packed like others. Other columns are ignored.
    """
    capacities = sorted(set(capacities))
    most = capacities[-1]
    rows = lengths.select("doc_id", "row", F.col("n_tokens").cast("long").alias("n")).where("n > 0")
    rows = rows.select("doc_id", "row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most))).alias("piece"))
    rows = written(rows.select("doc_id", "row", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most).cast("long"), F.col("n") - F.col("piece") * most).alias("n_tokens"),
                               F.monotonically_increasing_id().alias("at")), "pieces")
    blocks = rows.count() // BLOCK_PIECES + 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(blocks))).drop("at")
    schema = "doc_id long, row long, piece long, start long, n_tokens long, bin_id long, offset long, capacity long"
    return dealt.groupBy("block").applyInArrow(_pack(capacities), schema)


def word_lengths(docs: DataFrame) -> DataFrame:
    """``doc_id, row, n_tokens``: the words of each text and an end mark; a null or empty text is its end mark."""
    def count(batches):
        for batch in batches:
            sizes = [len((text or "").encode().split()) + 1 for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "row", "n_tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(count, "doc_id long, row long, n_tokens long")
