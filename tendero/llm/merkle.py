"""Merkle manifest of a dataset: one tree of leaves per group, and one tree over the groups.

The place of a leaf in its group is a rank query on a bitmap of the ids that the group holds. The bitmap is kept as
its words that are not zero; beside it stand directories of popcounts, each a summary of ``2 ** FAN`` entries of
the one below, so that a rank is a sum of one entry from each and of the bits below the id. No group is
sorted. Places then name slots: nodes are gathered by slot array, ``2 ** FAN`` slots together, and ``FAN`` levels are
reduced by each shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendero.llm.tables import written

#: Levels of a tree that one task reduces together, and bits between two directories of the index.
FAN = 8
#: Equal leaves that are laid out by one task.
RUN = 1 << 16
_WORD = 6


def leaf_of(columns: Sequence[Column]) -> Column:
    """SHA-256 over the fields: ``-`` for null, else the bytes of the value as text, ``:`` and the value."""
    fields = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & left[c].eqNullSafe(right[f"{c}_"])
    return condition


def _bases(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``counts`` (``by``, ``word``, ``n``) with ``base``: the sum of ``n`` over the smaller words of the group, null the smallest."""
    ends = counts.agg(F.min("word").alias("low"), F.max("word").alias("high")).first()
    top = ends["low"] is None or ends["high"] - ends["low"] < 1 << FAN
    near = [F.col(c) for c in by] if top else [*by, F.shiftright("word", FAN)]
    before = Window.partitionBy(*near).orderBy(F.asc_nulls_first("word")).rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    if top:
        return inside
    upper = _bases(written(counts.groupBy(*by, F.shiftright("word", FAN).alias("word")).agg(F.sum("n").alias("n")), "directory"), by)
    upper = upper.select(*(F.col(c).alias(f"{c}_") for c in (*by, "word", "base")))
    inside = inside.withColumn("up", F.shiftright("word", FAN))
    return inside.join(upper, _same(inside, upper, by) & inside["up"].eqNullSafe(upper["word_"])).select(*(inside[c] for c in (*by, "word", "n")), (inside["base"] + upper["base_"]).alias("base"))


def ranked(rows: DataFrame, by: Sequence[str], number: str) -> DataFrame:
    """``rows`` with ``rank``, the leaves of the same group below its number, and ``here``, those of its number.

    A row stands for ``c`` leaves. Null is below all numbers. A number that holds more than one leaf is listed beside the bits of its
    word, so a word's row is bounded whatever repeats.
    """
    here = rows.groupBy(*by, number).agg(F.sum("c").alias("here"))
    bit = F.col(number).bitwiseAND(F.lit(63).cast("long")).cast("int")
    here = here.withColumn("bit", bit)
    more = F.when((F.col("here") > 1) & F.col("bit").isNotNull(), F.struct("bit", (F.col("here") - 1).alias("more")))
    words = here.groupBy(*by, F.shiftright(number, _WORD).alias("word")).agg(
        F.coalesce(F.bit_or(F.expr("shiftleft(1L, bit)")), F.lit(0).cast("long")).alias("bits"), F.sum("here").alias("n"), F.collect_list(more).alias("more"))
    words = written(words, "words")
    bases = _bases(words.select(*by, "word", "n"), by).select(*(F.col(c).alias(f"{c}_") for c in (*by, "word")), "base")
    index = words.join(bases, _same(words, bases, [*by, "word"])).select(*(F.col(c).alias(f"{c}_") for c in (*by, "word")), "bits", "n", "more", "base")
    placed = rows.withColumn("word", F.shiftright(number, _WORD)).withColumn("bit", bit)
    placed = placed.join(index, _same(placed, index, [*by, "word"]))
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, bit)"))).cast("long")
    extra = F.expr("aggregate(filter(more, m -> m.bit < bit), 0L, (a, m) -> a + m.more)")
    own = F.expr("1L + aggregate(filter(more, m -> m.bit = bit), 0L, (a, m) -> a + m.more)")
    return placed.select(*rows.columns, (F.col("base") + F.coalesce(below + extra, F.lit(0).cast("long"))).alias("rank"), F.when(F.col("bit").isNull(), F.col("n")).otherwise(own).alias("here"))


def _leaf_places(leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``rank``: by id, then by digest. Leaves of one id are ranked by a second index over their digests."""
    placed = written(ranked(leaves, ["grp"], "id"), "ranks")
    tied = placed.where("c < here")
    if tied.isEmpty():
        return placed.drop("here")
    head = F.conv(F.hex(F.substring("leaf", 1, 7)), 16, 10).cast("long")
    inner = ranked(tied.withColumnRenamed("rank", "rank_of_id").drop("here").withColumn("head", head), ["grp", "id"], "head")
    rest = Window.partitionBy("grp", "id", "head").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)  # digests that agree in 56 bits
    inner = inner.withColumn("rank", F.col("rank_of_id") + F.col("rank") + F.coalesce(F.sum("c").over(rest), F.lit(0).cast("long")))
    return placed.where("c = here").drop("here").unionByName(inner.drop("here", "head", "rank_of_id"))


def _laid_out(leaves: DataFrame) -> DataFrame:
    """A row for each leaf at ``pos``; equal leaves stand side by side."""
    run = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("k")
    few = leaves.where(F.col("c") <= RUN)
    many = leaves.where(F.col("c") > RUN).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / RUN))).alias("part"))
    part = F.least(F.lit(RUN).cast("long"), F.col("c") - F.col("part") * RUN)
    many = many.select(*(c for c in leaves.columns if c not in ("c", "rank")), (F.col("rank") + F.col("part") * RUN).alias("rank"), part.alias("c")).hint("rebalance")
    whole = few.unionByName(many).select("*", run(F.col("c")))
    return whole.withColumn("pos", F.col("rank") + F.col("k")).drop("c", "rank", "k")


def _groups(leaves: DataFrame) -> DataFrame:
    """``grp, n, tree``: leaves of each group, and its place among the groups, null first, else by UTF-8 bytes."""
    counts = leaves.groupBy("grp").agg(F.sum("c").alias("n"))
    dealt = written(counts.repartitionByRange("grp").sortWithinPartitions("grp").withColumn("at", F.monotonically_increasing_id()), "groups")
    part, slot = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    parts = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("k")).withColumn("base", F.coalesce(F.sum("k").over(before), F.lit(0).cast("long")))
    dealt = dealt.withColumn("part", part).withColumn("slot", slot)
    return written(dealt.join(parts.select("part", "base"), "part").select("grp", "n", (F.col("base") + F.col("slot")).alias("tree")), "groups")


def node_of(*digests: bytes) -> bytes:
    """The node above some digests, which are joined as lower-case hex."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


FIELDS = ("tree", "n", "pos", "digest", "up", "path")


def _reduce(more: Sequence[str]) -> Callable:
    """Of the nodes of a slot array: each one's siblings on the way up, and the node on top in a row without ``pos``."""
    def reduce(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        nodes, n, size = table.column("digest").to_pylist(), table.column("n")[0].as_py(), table.num_rows
        paths: list[list[bytes]] = [[] for _ in nodes]
        for level in range(min(FAN, (n - 1).bit_length())):
            for slot, path in enumerate(paths):
                beside = slot >> level ^ 1
                if beside < len(nodes):
                    path.append(nodes[beside])
            nodes = [node_of(*nodes[k:k + 2]) for k in range(0, len(nodes), 2)]
        own = table.append_column("path", pa.array([b"".join(p) for p in paths], pa.binary())).select([*FIELDS, *more])
        top = {"tree": table.column("tree")[0].as_py(), "n": n, "digest": nodes[0], "up": table.column("up")[0].as_py()}
        return pa.concat_tables([own, pa.Table.from_pylist([top], own.schema)])

    return reduce


def _raised(nodes: DataFrame, most: int, more: Sequence[str]) -> tuple[list[DataFrame], DataFrame]:
    """For each ``FAN`` levels the nodes with the siblings they meet there, and at last the top of each tree.

    ``nodes`` has ``tree, n, pos, digest``, n the nodes of the tree on that level, at most ``most``.
    """
    rounds = []
    while True:
        kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
        schema = "tree long, n long, pos long, digest binary, up long, path binary" + "".join(f", {c} {kinds[c]}" for c in more)
        made = nodes.withColumn("up", F.shiftright("pos", FAN)).groupBy("tree", "up").applyInArrow(_reduce(more), schema)
        made = written(made, "level")
        rounds.append(made.where("pos IS NOT NULL"))
        tops = made.where("pos IS NULL")
        if most <= 1 << FAN:
            return rounds, tops.select("tree", "digest")
        most = -(-most >> FAN)
        nodes, more = tops.select("tree", F.shiftright(F.col("n") + ((1 << FAN) - 1), FAN).alias("n"), F.col("up").alias("pos"), "digest"), ()


def folded(digest: bytes, path: bytes, places: Sequence[tuple[int, int]]) -> bytes:
    """The root that a digest and its siblings lead to; ``places`` are ``pos, n`` in its tree and in each tree above."""
    at = 0
    for pos, n in places:
        while n > 1:
            beside = pos ^ 1
            if beside < n:
                sibling, at = path[at:at + 32], at + 32
                digest = node_of(digest, sibling) if beside > pos else node_of(sibling, digest)
            else:
                digest = node_of(digest)
            pos, n = pos >> 1, n + 1 >> 1
    return digest


def _verify(groups: int, root: bytes) -> Callable:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            leaves, subroots, proofs, roots, good = [], [], [], [], []
            for _, leaf, claimed, path, pos, n, tree, subroot in zip(*columns, strict=True):
                found = folded(leaf if claimed is None else claimed, path, ((pos, n), (tree, groups)))
                leaves.append(leaf.hex())
                subroots.append(subroot.hex())
                proofs.append(sha256(path.hex().encode()).hexdigest())
                roots.append(found.hex())
                good.append(found == root)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "leaf": leaves, "subroot": subroots, "root": [root.hex()] * len(leaves),
                                              "proof_sha256": proofs, "folded_root": roots, "verified": pa.array(good, pa.bool_())})

    return verify


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(rows: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``rows``.

    ``rows`` has ``grp`` (any text or null), ``id`` (long or null), ``leaf`` (a digest) and ``claimed``: the digest of what is
    to be verified, null where that is the leaf itself. Leaves of a group ascend by id, null first, and leaves of one
    id by digest; rows that repeat are leaves of their own, side by side. Two nodes make the one above them by
    SHA-256 of their hex; a last one alone is hashed by itself. Groups' roots, null first, then by the
    bytes of the name, make the root in the same way. ``proof_sha256`` covers the siblings from leaf to root,
    ``folded_root`` is what they and the claimed digest lead to. An empty table gives no rows.
    """
    equal = written(rows.groupBy("grp", "id", "leaf", "claimed").agg(F.count("*").alias("c")), "leaves")
    groups = _groups(equal)
    sizes = groups.agg(F.max("n").alias("most"), F.count("*").alias("groups")).first()
    if not sizes["groups"]:
        return rows.sparkSession.createDataFrame([], PROOFS)
    places = _laid_out(_leaf_places(equal))
    named = groups.withColumnRenamed("grp", "grp_")
    leaves = places.join(named, places["grp"].eqNullSafe(named["grp_"])).select("tree", "n", "pos", F.col("leaf").alias("digest"), "id", "claimed")
    rounds, subroots = _raised(leaves, sizes["most"], ("id", "claimed"))
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(sizes["groups"]).cast("long").alias("n"), F.col("tree").alias("pos"), "digest")
    above, roots = _raised(tops, sizes["groups"], ())
    root = bytes(roots.first()["digest"])

    # siblings from the root downwards: those of a node stand after those of the nodes it leads from
    top = _paths(above)
    top = subroots.join(top.select(F.col("pos").alias("tree"), F.col("path").alias("rest")), "tree").select("tree", F.col("digest").alias("subroot"), "rest")
    if len(rounds) > 1:
        inner = _paths(rounds[1:]).join(top, "tree").select("tree", F.col("pos").alias("up"), "subroot", F.concat("path", "rest").alias("rest"))
        proved = rounds[0].join(inner, ["tree", "up"])
    else:
        proved = rounds[0].join(top, "tree")
    proved = proved.select("id", "digest", "claimed", F.concat("path", "rest").alias("path"), "pos", "n", "tree", "subroot")
    return proved.mapInArrow(_verify(sizes["groups"], root), PROOFS)


def _paths(rounds: Sequence[DataFrame]) -> DataFrame:
    """``tree, pos, path`` of the nodes of the first round, up to the top of their tree."""
    found = rounds[-1].select("tree", "pos", "path")
    for lower in reversed(rounds[:-1]):
        found = lower.select("tree", "pos", "up", "path").join(found.select("tree", F.col("pos").alias("up"), F.col("path").alias("rest")), ["tree", "up"])
        found = found.select("tree", "pos", F.concat("path", "rest").alias("path"))
    return found
