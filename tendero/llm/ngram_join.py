"""Jaccard self-join of documents over word shingles, filtered under several token orders.

Sets with a Jaccard similarity of at least t share a shingle among the first
``n - ceil(t n) + 1`` of either, whatever order all shingles are put in. So a pair must pass that
test under each of several orders; the candidates of the first order are intersected with
the tests of the others before any set is compared.

Before that, pairs are tried by signatures: each shingle flips one of 256 bits, so two sets differ in at least
as many shingles as their signatures differ in bits. The test leaves no link out, and it is part
of the joins that make pairs, so that documents which merely share frequent shingles never become rows.

Every order puts shingles of busy counters last and breaks ties by its own hash. Counters are a
table of fixed size over the shingles of all documents, so it may be broadcast; a shared counter
only makes an order worse, never wrong.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendero.llm.components import components
from tendero.llm.tables import if_small, written
from tendero.llm.words import seeded, shingle_set, slices

ORDERS = 3
COUNTER_BITS = 22
BLOCK = 4096
#: Signature columns of 64 bits each.
SIGNATURE = ("s0", "s1", "s2", "s3")
#: Shingles of texts that a task holds before it counts them.
WAITING = 1 << 18

_SHIFT = np.uint64(64 - COUNTER_BITS)


def _packed(counts: np.ndarray) -> bytes:
    """The counts in the narrowest type that holds them."""
    most = int(counts.max())
    kind = np.uint8 if most < 256 else np.uint16 if most < 65536 else np.int64
    return counts.astype(kind).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 8: np.int64}[len(raw) // BLOCK]).astype(np.int64)


def _count_shingles(size: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, waiting, held = np.zeros(1 << COUNTER_BITS, np.uint32), [], 0  # a task has fewer documents than that counts

        def add() -> None:
            slots, counts = np.unique(np.concatenate(waiting), return_counts=True)
            table[slots] += counts.astype(np.uint32)

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                waiting.append((shingle_set(text, size) >> _SHIFT).astype(np.int32))
                held += len(waiting[-1])
                if held > WAITING:
                    add()
                    waiting, held = [], 0
        if held:
            add()
        parts = table.reshape(-1, BLOCK)
        used = np.flatnonzero(parts.any(axis=1))
        for some in np.array_split(used, max(1, len(used) // 128)):
            yield pa.RecordBatch.from_pydict({"block": pa.array(some, pa.int32()), "counts": pa.array([_packed(parts[i]) for i in some], pa.binary())})

    return count


def _sum_counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[block] = sums[block] + _unpacked(raw) if block in sums else _unpacked(raw)
    levels = [np.ceil(np.log2(np.maximum(x, 1))).astype(np.uint8).tobytes() for x in sums.values()]
    yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "levels": pa.array(levels, pa.binary())})


def shingle_levels(texts: DataFrame, size: int) -> np.ndarray:
    """How busy each counter is: 0 for one document at most, then in powers of two, those up to the usual alike."""
    counted = texts.select("text").mapInArrow(_count_shingles(size), "block int, counts binary")
    summed = counted.repartition("block").mapInArrow(_sum_counters, "block int, levels binary")
    levels = np.zeros((1 << COUNTER_BITS) // BLOCK * BLOCK, np.uint8).reshape(-1, BLOCK)
    for row in summed.toLocalIterator():
        levels[row["block"]] = np.frombuffer(row["levels"], np.uint8)
    levels = levels.reshape(-1)
    usual = max(1, int(np.median(levels)))
    return np.where(levels == 0, 0, np.maximum(levels, usual) - np.uint8(usual - 1)).astype(np.uint8)


def _prefix(own: np.ndarray, busy: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first shingles of a set under one order, as many as any similar set must share one of."""
    take = len(own) + (-percent * len(own)) // 100 + 1
    if take >= len(own):
        return own
    key = busy[(own >> _SHIFT).astype(np.int64)].astype(np.uint64) << np.uint64(58) | (seeded(own, order) >> np.uint64(6))
    return own[np.argpartition(key, take - 1)[:take]]


def _signature(own: np.ndarray) -> np.ndarray:
    """For each bit whether an odd number of the shingles fall on it."""
    width = 64 * len(SIGNATURE)
    bits = (seeded(own, ORDERS) % np.uint64(width)).astype(np.int64)
    return np.packbits((np.bincount(bits, minlength=width) & 1).astype(np.uint8)).view(np.int64)


def _prefixes(size: int, percent: int, levels) -> Callable:
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        busy = np.frombuffer(levels.value, np.uint8)
        for batch in slices(batches):
            counts, alone, classes, signs, prefixes = [], [], [], [], [[] for _ in range(ORDERS)]
            for text in batch.column(1).to_pylist():
                own = shingle_set(text, size)
                counts.append(len(own))
                alone.append(int((busy[(own >> _SHIFT).astype(np.int64)] == 0).sum()))
                signs.append(_signature(own))
                classes.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                for order, made in enumerate(prefixes):
                    first = _prefix(own, busy, order, percent)
                    made.append(first.astype(np.uint32).view(np.int32) if order else first.view(np.int64))
            signs = np.array(signs).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(alone, pa.int64()), pa.array(classes, pa.binary()),
                 *(pa.array(part, pa.int64()) for part in signs),
                 *(pa.array(made, pa.list_(pa.int32() if order else pa.int64())) for order, made in enumerate(prefixes))],
                names=["doc_id", "n", "alone", "class", *SIGNATURE, *(f"p{k}" for k in range(ORDERS))])

    return describe


def _sets(size: int) -> Callable:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [shingle_set(text, size).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "items"])

    return make


def _compare(percent: int, levels) -> Callable:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        busy = np.frombuffer(levels.value, np.uint8)

        def similar(x: np.ndarray, y: np.ndarray) -> bool:
            for order in range(1, ORDERS):
                if not len(np.intersect1d(_prefix(x, busy, order, percent), _prefix(y, busy, order, percent), assume_unique=True)):
                    return False
            both = len(np.intersect1d(x, y, assume_unique=True))
            return 100 * both >= percent * (len(x) + len(y) - both)

        for batch in slices(batches, "items_a"):
            keep = [similar(*(np.frombuffer(z.as_buffer(), np.uint64) for z in pair)) for pair in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    return compare


def _ends(pairs: DataFrame) -> DataFrame:
    """The documents of some pairs, to pick their rows where they lie."""
    return if_small(written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "members"), 16)


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether sets, whose columns end in ``a`` and ``b``, may link by their signatures: a link allows that many different shingles."""
    apart = sum((F.bit_count(F.col(s + a).bitwiseXOR(F.col(s + b))) for s in SIGNATURE), F.lit(0))
    return (100 + percent) * apart <= (100 - percent) * (F.col("n" + a) + F.col("n" + b))


def _verified(pairs: DataFrame, described: DataFrame, texts: DataFrame, size: int, percent: int, levels) -> DataFrame:
    """``a, b, linked`` for those of the pairs, which share a prefix under the first order, that pass their signatures and the others.

    Half of each hash is enough to intersect the other orders' prefixes; what passes is tried
    by whole hashes before its sets are compared.
    """
    pairs = written(pairs, "pairs")
    others = [f"p{k}" for k in range(1, ORDERS)]
    near = described.join(_ends(pairs), "doc_id", "left_semi")
    side = lambda end: near.select(F.col("doc_id").alias(end), *(F.col(p).alias(f"{p}_{end}") for p in ("n", *SIGNATURE, *others)))
    tried = pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link("_a", "_b", percent))
    for p in others:
        tried = tried.where(F.arrays_overlap(f"{p}_a", f"{p}_b"))
    pairs = written(tried.select("a", "b").distinct(), "candidates")
    sets = texts.join(_ends(pairs), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets(size), "doc_id long, items binary")
    sets = written(sets, "sets")
    paired = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a")), "a")
              .join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b")), "b")
              .select("a", "b", "items_a", "items_b"))
    return written(paired.mapInArrow(_compare(percent, levels), "a long, b long, linked boolean"), "compared")


def ngram_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (``doc_id``, ``text``).

    Two documents link when ``100 * intersection >= percent * union`` of their shingle sets;
    ``component_id`` is the smallest id reachable by links. Documents of one and the same set
    are handled as one. A null, empty or word-free text has no shingles and links with nothing. A
    row without id takes no part: its component is null. Rows that repeat an id are judged by
    their own text. Further columns are ignored.

    Large groups of near copies are not compared pair by pair. First, every document is compared with
    one of its lists' documents, that with the fewest shingles of its own; then documents of one list are
    compared only where they are not yet connected. No link between components is left out, so
    the components are those of all links.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    levels = spark.sparkContext.broadcast(shingle_levels(texts, size).tobytes())
    schema = "doc_id long, n long, alone long, class binary, " + "".join(f"{s} long, " for s in SIGNATURE) + "p0 array<long>, " + ", ".join(f"p{k} array<int>" for k in range(1, ORDERS))
    described = written(texts.mapInArrow(_prefixes(size, percent, levels), schema), "prefixes")
    classes = described.where("n > 0 AND doc_id IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("rep"))
    members = written(described.select("doc_id", "n", "class").join(classes, "class", "left"), "classes")
    reps = written(members.where("doc_id = rep").select("doc_id").distinct(), "reps")

    # shingles no other document has are shared with none, which bounds what a pair can share
    postings = described.where("n > 0").select("doc_id", "n", "alone", "p0").join(if_small(reps, 16), "doc_id", "left_semi")
    postings = postings.select(F.col("doc_id").alias("rep"), "n", (F.col("n") - F.col("alone")).alias("m"), F.explode("p0").alias("token"))
    # a list's lead: the fewest shingles of its own, then a hash. One number, and plain ones beside it: these are summed up by
    # hashing, where a row of several would have all postings sorted
    rank = F.shiftleft(F.col("n") - F.col("m"), 32) + F.xxhash64("rep").bitwiseAND(F.lit(0xFFFFFFFF))
    lists = postings.withColumn("rank", rank).groupBy("token").agg(
        F.min("rank").alias("rank"), F.min_by("rep", "rank").alias("lead"), F.min_by("m", "rank").alias("m_lead"), F.count("*").alias("k"))
    lists = lists.where("k > 1").select("token", "rank", "lead", (F.shiftright("rank", 32) + F.col("m_lead")).alias("n_lead"), "m_lead")
    postings = written(postings.join(lists, "token"), "postings")

    def near(n_a, m_a, n_b, m_b):
        most = F.least(F.col(m_a), F.col(m_b))
        return 100 * most >= percent * (F.col(n_a) + F.col(n_b) - most)

    stars = postings.where((F.col("rep") != F.col("lead")) & near("n", "m", "n_lead", "m_lead")).groupBy("rep").agg(F.min_by("lead", "rank").alias("lead"))
    first = _verified(stars.select(F.col("lead").alias("a"), F.col("rep").alias("b")), described, texts, size, percent, levels)
    links = first.where("linked").select("a", "b")
    known = components(links, "a", "b")

    placed = postings.select("token", "rep", "n", "m").join(known.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.withColumn("component", F.coalesce("component", "rep"))
    groups = placed.groupBy("token", "component").agg(F.count("*").alias("k")).groupBy("token").agg(
        F.max_by("component", "k").alias("main"), F.count("*").alias("groups"))
    placed = placed.join(groups.where("groups > 1").select("token", "main"), "token")
    signs = described.select(F.col("doc_id").alias("rep"), "n", F.expr("n - alone").alias("m"), *SIGNATURE).distinct()
    placed = written(placed.join(signs, ["rep", "n", "m"]), "placed")
    rest = placed.where("component != main").select(
        "token", F.col("rep").alias("x"), F.col("component").alias("c_x"), *(F.col(c).alias(c + "_x") for c in ("n", "m", *SIGNATURE)))
    across = rest.join(placed, "token").where(
        (F.col("component") != F.col("c_x")) & near("n", "m", "n_x", "m_x") & _may_link("", "_x", percent)
        & ((F.col("component") == F.col("main")) | (F.col("rep") > F.col("x"))))
    across = across.select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()
    across = across.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    second = _verified(across, described, texts, size, percent, levels)
    known = components(links.union(second.where("linked").select("a", "b")), "a", "b")

    placed = members.join(known.withColumnRenamed("node", "rep"), "rep", "left")
    return placed.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all columns as they were.

    Rows without id stay, as they link with nothing; rows that repeat an id stay or go together.
    """
    found = ngram_components(docs, size, percent)
    first = written(found.where("doc_id = component_id").select("doc_id").distinct(), "first")
    return docs.join(if_small(first, 16), docs["doc_id"].cast("long") == first["doc_id"], "left_semi").unionByName(docs.where(docs["doc_id"].isNull()))
