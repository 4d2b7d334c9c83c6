"""Documents that hold passages of a benchmark, found by spaced seeds.

DataFrame functions only. A seed hashes the words at the places of a mask and ignores those
between. The two masks together hit every aligned stretch of ``OVERLAP`` words with at most
``SUBSTITUTED`` words replaced. Around each hit the two texts are then compared word by word.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendero.llm.tables import if_small, written

OVERLAP = 13
SUBSTITUTED = 2
#: Places that count, from the first word of a seed. A test holds them against all replacements.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 7, 8))
#: Bytes up to which the seeds of the benchmark are sent to every executor; more are joined by key.
BROADCAST_BYTES = 64 << 20

_SPACE = " \t\n\v\f\r"


def words(text: Column) -> Column:
    """The words with A-Z lower-cased; none for a null text."""
    trimmed = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(_SPACE))
    found = F.split(F.translate(trimmed, ascii_uppercase, ascii_lowercase), r"[\x20\x09-\x0D]+")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(found)


def _seeds(rows: DataFrame, found: Column, *keep: str) -> DataFrame:
    """``seed, at`` for every place of every mask over the words ``found``.

    The hashes go through ``explode`` so that the optimizer does not compute them again for each place.
    """
    rows = rows.select(*keep, F.explode(F.array(F.transform(found, lambda w: F.xxhash64(w)))).alias("hashes"))
    hashes = F.col("hashes")
    count = lambda mask: F.greatest(F.size(hashes) - mask[-1], F.lit(0))

    def under(number: int, mask: tuple[int, ...]) -> Column:
        return F.transform(F.slice(hashes, F.lit(1), count(mask)), lambda _, i: F.xxhash64(F.lit(number), *(F.get(hashes, i + k) for k in mask)))

    made = rows.select(*keep, F.concat(*(under(n, m) for n, m in enumerate(MASKS))).alias("seeds"), count(MASKS[0]).alias("first"))
    spread = made.select(*keep, "first", F.posexplode("seeds").alias("at", "seed"))
    return spread.select(*keep, "seed", F.when(F.col("at") < F.col("first"), F.col("at")).otherwise(F.col("at") - F.col("first")).alias("at"))


def _overlaps(w: Column, v: Column, offset: Column) -> Column:
    """Whether some ``OVERLAP`` aligned words differ in ``SUBSTITUTED`` at most."""
    low = F.greatest(F.lit(0), -offset)
    high = F.least(F.size(v), F.size(w) - offset) - 1
    same = F.transform(F.sequence(low, F.greatest(low, high)), lambda k: (F.get(w, offset + k) == F.get(v, k)).cast("int"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), high - low + 2 - OVERLAP))
    found = F.exists(starts, lambda s: F.aggregate(F.slice(same, s, F.lit(OVERLAP)), F.lit(0), lambda x, y: x + F.coalesce(y, F.lit(0))) >= OVERLAP - SUBSTITUTED)
    return F.when(high - low + 1 >= OVERLAP, found).otherwise(F.lit(False))


def _same() -> Column:
    return F.expr("doc_id <=> d AND row = r")


def _found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``d, r, n_items, first_item`` for the contaminated rows: id and hash of id and text."""
    items = written(items.select("item_id", words(F.col("text")).alias("v")).where(F.size("v") >= OVERLAP)
                    .groupBy("v").agg(F.min("item_id").alias("item_id")).withColumn("item", F.xxhash64("v")), "items")
    tests = _seeds(items, F.col("v"), "item").withColumnRenamed("at", "at_item").distinct()
    tests = written(tests, "seeds")
    if tests.count() * 40 <= BROADCAST_BYTES:
        tests = F.broadcast(tests)
    train = _seeds(docs, words(F.col("text")), "doc_id", "row")
    hits = train.join(tests, "seed").select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "item", (F.col("at") - F.col("at_item")).alias("offset")).distinct()
    hits = written(hits, "hits")
    rows = if_small(written(hits.select("d", "r").distinct(), "hit-rows"), 24)
    near = docs.join(rows, _same(), "left_semi")
    near = near.dropDuplicates(["doc_id", "row", "text"]).select("doc_id", "row", words(F.col("text")).alias("w"))
    checked = hits.join(items, "item").join(near, _same()).where(_overlaps(F.col("w"), F.col("v"), F.col("offset")))
    found = checked.groupBy("d", "r").agg(F.count_distinct("item").alias("n_items"), F.min("item_id").alias("first_item"))
    return written(found, "found")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", F.col("text").cast("string")).alias("row"), F.col("text").cast("string").alias("text"))


def benchmark_overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, contaminated, n_items, first_item`` for each row of ``docs``.

    A document (``doc_id``, ``text``) is contaminated by an item (``item_id``, ``text``) if
    ``OVERLAP`` consecutive words of one stand against as many of the other with at most
    ``SUBSTITUTED`` of them different, A-Z folded. ``n_items`` counts such items by their words,
    ``first_item`` is the smallest id among them (null if they have none). Null, empty and shorter
    texts on either side overlap with nothing. Every row is judged by its own text, whatever its
    id. Other columns are ignored.
    """
    rows = _rows(docs)
    judged = rows.select("doc_id", "row").join(_found(rows, items), _same(), "left")
    return judged.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), "first_item")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`benchmark_overlaps` does not find contaminated, all columns as they were."""
    found = _found(_rows(docs), items).select("d", "r")
    same = docs["doc_id"].eqNullSafe(found["d"]) & (F.xxhash64(docs["doc_id"], docs["text"].cast("string")) == found["r"])
    return docs.join(if_small(found, 24), same, "left_anti")
