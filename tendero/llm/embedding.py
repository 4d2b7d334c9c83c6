"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines.

A table's key is a row of quantised random projections of the normalised vector. Vectors of one key
are compared exactly; a pair that meets in several tables counts in the first. Busy keys are split into
blocks that are compared two by two, and links leave a task as counts and as a
spanning forest, never as all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendero.llm.components import components
from tendero.llm.tables import written
from tendero.llm.words import mix

WIDTH = 2.0
#: Share of the pairs just at the threshold that may be missed; closer pairs are missed less.
MISSED = 0.02
#: Unrelated vectors that share a key with a given one, on average, at most.
STRANGERS = 0.05
BLOCK = 1024

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _meet(distance: float) -> float:
    """Chance that one projection puts two vectors of this distance into the same cell."""
    x = WIDTH / distance
    tail = 0.5 * math.erfc(x / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def plan(rows: int, threshold: float) -> tuple[int, int]:
    """Projections in a key and number of tables, from the number of vectors and the cosine."""
    near, far = _meet(math.sqrt(max(1e-6, 2 - 2 * threshold))), _meet(math.sqrt(2))
    size = max(4, math.ceil(math.log(max(rows, 1) / STRANGERS) / -math.log(far)))
    return size, max(1, math.ceil(math.log(MISSED) / math.log(1 - near ** size)))


def _unit(value: list | None) -> np.ndarray | None:
    if not value or any(x is None for x in value):
        return None
    x = np.array(value, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()
    return x / np.sqrt(x @ x)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = []
        for value in batch.column(1).to_pylist():
            x = _unit(value)
            raw.append(None if x is None else x.tobytes())
        named = [None if x is None else xxhash.xxh3_128_digest(x) for x in raw]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "class", "unit"])


def _keys(size: int, tables: int, seed: int) -> Callable:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            made = []
            for raw in batch.column(1):
                x = np.frombuffer(raw.as_buffer(), np.float64)
                if len(x) not in drawn:
                    random = np.random.default_rng((seed, len(x)))
                    drawn[len(x)] = random.standard_normal((len(x), tables * size)), random.uniform(0, WIDTH, tables * size)
                along, shift = drawn[len(x)]
                cells = np.floor((x @ along + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(tables, size)
                key = np.full(tables, len(x), np.uint64)
                for k in range(size):
                    key = mix(key * _ODD + cells[:, k])
                made.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["rep", "keys"])

    return make


def _links(threshold: float) -> Callable:
    def compare(table: pa.Table) -> pa.Table:
        number, left, right = (table.column(c)[0].as_py() for c in ("table", "i", "j"))
        rep, copies, own = (table.column(c).to_numpy() for c in ("rep", "copies", "own"))
        units = np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in table.column("unit").combine_chunks()])
        keys = np.array(table.column("keys").to_pylist(), np.int64)
        a, b = np.flatnonzero(own == left), np.flatnonzero(own == right)
        linked = units[a] @ units[b].T >= threshold
        linked &= rep[a][:, None] < rep[b] if left == right else True
        x, y = np.nonzero(linked)
        x, y = a[x], b[y]
        fresh = ~(keys[x, :number] == keys[y, :number]).any(axis=1)
        links = np.bincount(x[fresh], copies[y[fresh]], len(rep)) + np.bincount(y[fresh], copies[x[fresh]], len(rep))
        low = rep.copy()
        while True:  # the smallest vector that links lead to, inside this group
            before = low.copy()
            np.minimum.at(low, x, before[y])
            np.minimum.at(low, y, before[x])
            if (low == before).all():
                break
        touched = np.flatnonzero((links > 0) | (low != rep))
        return pa.table({"rep": rep[touched], "links": links[touched].astype(np.int64), "root": low[touched]})

    return compare


def near_vectors(vectors: DataFrame, threshold: float = 0.95, seed: int = 7) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors`` (``vec_id``, ``embedding``).

    Two rows link when the cosine of their vectors, in double precision, reaches ``threshold``; every
    link reported is exact, and of the pairs just at the threshold about ``MISSED`` are not found. Equal
    directions always link. Null, empty and zero vectors and those with a null or non-finite component link
    with nothing, nor do vectors of different length. ``component_id`` is the smallest id reachable by
    links, ``kept`` marks the row that has it. Repeated rows are vectors of their own; rows
    without id link with nothing and have no component. Other columns are ignored.
    """
    ids = F.col("vec_id").cast("long").alias("vec_id")
    rows = written(vectors.select(ids, F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_describe, "vec_id long, class binary, unit binary"), "units")
    usable = rows.where("vec_id IS NOT NULL AND class IS NOT NULL")
    classes = written(usable.groupBy("class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("unit").alias("unit")), "classes")
    size, tables = plan(classes.count(), threshold)
    keys = written(classes.select("rep", "unit").mapInArrow(_keys(size, tables, seed), "rep long, keys array<long>"), "keys")

    spread = keys.select("rep", F.posexplode("keys").alias("table", "key"))
    busy = spread.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = spread.join(busy, ["table", "key"]).select("table", "key", "rep", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("own"))
    met = met.select("table", "key", "rep", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("table", "key", "rep", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    met = met.join(classes.select("rep", "copies", "unit"), "rep").join(keys, "rep")
    found = written(met.groupBy("table", "key", "i", "j").applyInArrow(_links(threshold), "rep long, links long, root long"), "links")

    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = components(found.where("root != rep").select("rep", "root"), "rep", "root")
    placed = classes.select("class", "rep", "copies").join(linked, "rep", "left").join(known.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("class")).alias("class")).join(placed, "class", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
