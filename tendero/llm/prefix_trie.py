"""Trie of conversation prefixes, built as a z-fast trie over the distinct turn sequences.

A turn is a hash and a size; a sequence of turns is known by the chained hash of each of its prefixes, so
"two sequences agree up to depth d" is one comparison.

The trie is held as paths. A sequence that is inserted becomes the path that leaves an earlier path, its host, at some
depth; the paths' ends and the depths where others leave cut them into compacted nodes. Each compacted node
is filed under its handle: the hash of the prefix at the two-fattest depth of its edge, the multiple of the highest power
of two in it. The exit edge of a new sequence is found by fat binary search: as many look-ups (joins) as
the longest sequence's length has bits, whatever the size of the trie.

Sequences are inserted in batches. All of a batch are located in the trie as it stands; of those that leave the same
edge at the same depth with the same turn one, chosen by hash, goes in, and the others go on from its path. So groups of any
size are halved, on average, from round to round, and no task ever holds a group.

At last the edges are expanded into a node for each depth, paths that hang on others first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from hashlib import sha256

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendero.llm.tables import written

#: Batches, as shares of all sequences: the first is small, the later ones find a trie.
SHARES = (1, 5, 19)
#: Ids in one row of a list that is hashed.
IDS = 12
NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_lists(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns as ``turn, key, size`` in order (``conv_id``, ``turn``, ``role``, ``text``).

    Turns ascend by number, null first; those of one number stand by the hash of role and text. Null role or
    text is empty. Rows without conversation take no part. A conversation's turns move as some 40 bytes each, and a task
    holds one conversation's at a time.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    own = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            prefixes, ends = [], []
            for keys in part.column(1).to_pylist():
                last, own = b"", []
                for key in keys:
                    last = xxhash.xxh3_128_digest(last + key)
                    own.append(last)
                prefixes.append(own)
                ends.append(last)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ends, pa.binary()), pa.array(prefixes, pa.list_(pa.binary())), part.column(2)],
                                             names=["conv_id", "seq", "prefix", "sizes"])


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, None
    for batch in batches:
        seqs, digests = [], []
        for seq, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if seq == now:
                state.update(b",")
            else:
                if state:
                    seqs.append(now)
                    digests.append(state.hexdigest())
                now, state = seq, sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_pydict({"seq": pa.array(seqs, pa.binary()), "ends_sha256": pa.array(digests, pa.string())})
    if state:
        yield pa.RecordBatch.from_pydict({"seq": pa.array([now], pa.binary()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})


def id_digests(members: DataFrame) -> DataFrame:
    """``seq, ends_sha256``: SHA-256 of the ascending ids of each sequence, joined by commas.

    Ids are put into rows of text by ranges first; a task then feeds one row at a time to the hash.
    """
    part = F.shiftright("conv_id", IDS).alias("part")
    lists = members.groupBy("seq", part).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return lists.repartition("seq").sortWithinPartitions("seq", "part").select("seq", "ids").mapInArrow(_hash_ids, "seq binary, ends_sha256 string")


# ---- the z-fast trie ---------------------------------------------------------

PATHS = "m long, host long, lam long, size long, level int"
_FAT = "shiftleft(shiftright({high}, {bits}), {bits})"


def _two_fattest(low: str, high: str) -> str:
    """Of the depths above ``low`` up to ``high`` the one that the highest power of two divides."""
    return _FAT.format(high=high, bits=f"cast(floor(log2({low} ^ {high})) as int)")


def dictionary(paths: DataFrame, sequences: DataFrame) -> DataFrame:
    """The compacted nodes: ``handle, depth, extent, first, owner, level``.

    ``extent`` is the hash of the whole prefix, ``first`` that of the prefix one turn into the edge, ``owner`` the path it lies on.
    """
    ends = paths.where("size > lam").select("m", F.col("size").alias("depth"))
    forks = paths.where("lam > 0").select(F.col("host").alias("m"), F.col("lam").alias("depth"))
    along = Window.partitionBy("m").orderBy("depth")
    edges = ends.union(forks).distinct().withColumn("before", F.lag("depth").over(along))
    edges = edges.join(paths.select("m", "lam", "level"), "m").withColumn("low", F.coalesce("before", "lam"))
    edges = edges.join(sequences.select("m", "prefix"), "m")
    at = lambda d: F.expr(f"prefix[cast({d} as int) - 1]")
    return edges.select(at(_two_fattest("low", "depth")).alias("handle"), "depth", at("depth").alias("extent"), at("low + 1").alias("first"), F.col("m").alias("owner"), "level")


def located(batch: DataFrame, paths: DataFrame, sequences: DataFrame, longest: int) -> DataFrame:
    """``batch`` with the path on which it leaves the trie (``host``, ``level``), by fat binary search over handles."""
    nodes = written(dictionary(paths, sequences), "handles")
    found = batch.select("m", "prefix", "size", F.lit(0).cast("long").alias("low"), F.col("size").alias("high"), F.lit(None).cast("long").alias("host"), F.lit(0).alias("level"), F.lit(False).alias("inside"))
    by_handle = nodes.select(F.col("handle"), "depth", "extent", "owner", F.col("level").alias("deep"))
    for _ in range(longest.bit_length() + 1):
        found = found.withColumn("fat", F.when(F.col("low") < F.col("high"), F.expr(_two_fattest("low", "high"))))
        met = found.withColumn("probe", F.expr("prefix[cast(fat as int) - 1]")).join(by_handle, F.col("probe") == F.col("handle"), "left")
        hit = F.col("handle").isNotNull()
        whole = hit & F.coalesce(F.expr("depth <= size AND prefix[cast(least(depth, size) as int) - 1] = extent"), F.lit(False))
        found = met.select(
            "m", "prefix", "size",
            F.when(whole, F.col("depth")).otherwise(F.col("low")).alias("low"),
            F.when(hit & ~whole, F.col("low")).when(whole, F.greatest("high", "depth")).when(F.col("fat").isNotNull(), F.col("fat") - 1).otherwise(F.col("high")).alias("high"),
            F.when(hit, F.col("owner")).otherwise(F.col("host")).alias("host"), F.when(hit, F.col("deep")).otherwise(F.col("level")).alias("level"),
            (F.col("inside") | (hit & ~whole)).alias("inside"))
    # the search ends at a node: the edge that goes on from it with the next turn, if there is one, is where the sequence leaves
    by_first = nodes.select("first", "owner", F.col("level").alias("deep"))
    found = found.withColumn("next", F.when(~F.col("inside") & (F.col("low") < F.col("size")), F.expr("prefix[cast(low as int)]")))
    found = found.join(by_first, F.col("next") == F.col("first"), "left")
    return found.select("m", "prefix", "size", F.coalesce("owner", "host").alias("host"), F.when(F.col("owner").isNotNull(), F.col("deep")).otherwise(F.col("level")).alias("level"))


def _agree(found: DataFrame, sequences: DataFrame) -> DataFrame:
    """``found`` with ``lam``: the depth up to which a sequence agrees with its host. Without host it leaves at the root."""
    hosts = sequences.select(F.col("m").alias("h"), F.col("prefix").alias("other"))
    same = F.expr("cast(size(filter(transform(prefix, (x, i) -> x = get(other, i)), e -> e)) as long)")
    alone = found.where("host IS NULL").withColumn("lam", F.lit(0).cast("long"))
    met = found.where("host IS NOT NULL").join(hosts, F.col("host") == F.col("h")).withColumn("lam", same).drop("h", "other")
    return alone.unionByName(met)


def inserted(batch: DataFrame, paths: DataFrame | None, sequences: DataFrame, longest: int) -> DataFrame:
    """``paths`` with those of a batch added: ``m, host, lam, size, level``."""
    if paths is None:
        waiting = batch.select("m", "prefix", "size", F.lit(None).cast("long").alias("host"), F.lit(0).alias("level"))
        parts = []
    else:
        waiting, parts = located(batch, paths, sequences, longest), [paths]
    while True:
        waiting = written(_agree(waiting, sequences).withColumn("next", F.expr("get(prefix, cast(lam as int))")), "waiting")
        ended = waiting.where("size = lam")
        going = waiting.where("size > lam")
        won = going.groupBy("host", "lam", "next").agg(F.max_by("m", F.xxhash64("m")).alias("winner")).select(F.col("host").alias("h"), F.col("lam").alias("l"), F.col("next").alias("x"), "winner")
        going = written(going.join(won, F.col("host").eqNullSafe(F.col("h")) & (F.col("lam") == F.col("l")) & (F.col("next") == F.col("x"))).drop("h", "l", "x"), "going")
        depth = F.when(F.col("host").isNull(), 0).otherwise(F.col("level") + 1).cast("int").alias("level")
        parts.append(ended.unionByName(going.where("m = winner"), allowMissingColumns=True).select("m", "host", "lam", "size", depth))
        waiting = going.where("m != winner").select("m", "prefix", "size", F.col("winner").alias("host"), depth)
        if waiting.isEmpty():
            return written(reduce(DataFrame.union, parts), "paths")


# ---- expansion ----------------------------------------------------------------

def _expanded(paths: DataFrame, hung: DataFrame, sequences: DataFrame) -> DataFrame:
    """The nodes of some paths, with what hangs on them: ``m, depth, lam, ...`` for each depth of each path."""
    edges = paths.join(sequences.select("m", "sizes"), "m")
    rows = edges.select("m", "lam", "size", "host", F.explode(F.expr("sequence(lam + 1, size)")).alias("depth"), "sizes").select(
        "m", "lam", "size", "host", "depth", F.expr("sizes[cast(depth as int) - 1]").alias("bytes"))
    rows = rows.join(hung.select(F.col("host").alias("m"), F.col("lam").alias("depth"), "convs", "first", "children", "leaves", "saved", "ends"), ["m", "depth"], "left")
    below = Window.partitionBy("m").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    rows = rows.withColumn("n_convs", F.sum(zero("convs")).over(below)).withColumn("conv_id", F.min("first").over(below))
    rows = rows.withColumn("n_children", zero("children") + (F.col("depth") < F.col("size")).cast("long"))
    rows = rows.withColumn("n_leaves", F.sum(zero("leaves") + (F.col("n_children") == 0).cast("long")).over(below))
    rows = rows.withColumn("saved_tokens", F.sum(zero("saved") + (F.col("n_convs") - 1) * F.col("bytes")).over(below))
    rows = rows.withColumn("parent_conv_id", F.lead("conv_id").over(Window.partitionBy("m").orderBy(F.desc("depth"))))
    return rows.select("m", "depth", "lam", "host", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")


def _hung(parts: Sequence[DataFrame]) -> DataFrame:
    """What hangs on each path at each depth, summed: sequences that end there and paths that leave there."""
    return reduce(DataFrame.unionByName, parts).groupBy("host", "lam").agg(
        F.sum("convs").alias("convs"), F.min("first").alias("first"), F.sum("children").alias("children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"))


def prefix_trie(lists: DataFrame, shares: Sequence[int] = SHARES) -> DataFrame:
    """A row for each distinct prefix of the conversations in ``lists`` (``conv_id``, ``turns``; see :func:`turn_lists`).

    ``conv_id`` the smallest member, ``depth``, ``parent_conv_id``, ``n_convs`` members, ``n_children``, ``n_leaves`` childless nodes in the
    subtree, ``saved_tokens``: over the subtree, each node's members less one times the bytes of its last text, ``ends_sha256`` of the ascending ids
    that end there. Subtrees include their top. The root has depth 0 and no parent; a conversation without turns ends there. No
    conversations give no rows. Each ``conv_id`` must stand once.
    """
    chained = lists.select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.size").alias("sizes"))
    chained = written(chained.mapInArrow(_chain, "conv_id long, seq binary, prefix array<binary>, sizes array<long>"), "chained")
    counted = chained.groupBy("seq").agg(F.count("*").alias("convs"), F.min("conv_id").alias("m"))
    digests = id_digests(chained.select("seq", "conv_id"))
    named = written(counted.join(digests, "seq").drop("seq"), "sequences")
    sequences = written(chained.withColumnRenamed("conv_id", "m").join(named.select("m", "convs"), "m").select("m", "prefix", "sizes", "convs", F.size("prefix").cast("long").alias("size")), "prefixes")
    longest = sequences.agg(F.max("size")).first()[0]
    if longest is None:
        return lists.sparkSession.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in NODES))

    paths, upto, share = None, 0, F.pmod(F.xxhash64(F.lit("batch"), "m"), F.lit(sum(shares)))
    for size in shares:
        batch = sequences.where((F.col("size") > 0) & share.between(upto, upto + size - 1))
        upto += size
        if not batch.isEmpty():
            paths = inserted(batch, paths, sequences, longest)

    nothing = F.lit(0).cast("long")
    levels, tops = [], []
    if paths is not None:
        own = paths.join(sequences.select("m", "convs"), "m")
        # a sequence ends on its own path, or, where it is a prefix of its host, on the host's
        ends = own.select(F.when(F.col("size") > F.col("lam"), F.col("m")).otherwise(F.col("host")).alias("host"), F.col("size").alias("lam"), "convs", F.col("m").alias("first"),
                          nothing.alias("children"), nothing.alias("leaves"), nothing.alias("saved"), F.col("m").alias("ends"), (F.col("level") - (F.col("size") == F.col("lam")).cast("int")).alias("level"))
        ends = written(ends, "ends")
        tops = []
        for level in range(paths.agg(F.max("level")).first()[0], -1, -1):
            hung = _hung([ends.where(F.col("level") == level).drop("level"), *tops])
            made = written(_expanded(paths.where((F.col("level") == level) & (F.col("size") > F.col("lam"))), hung, sequences), "nodes")
            levels.append(made)
            top = made.where("depth = lam + 1").select("host", "lam", F.col("n_convs").alias("convs"), F.col("conv_id").alias("first"), F.lit(1).cast("long").alias("children"),
                                                        F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(None).cast("long").alias("ends"))
            tops = [top]
    turnless = sequences.where("size = 0").select(F.lit(None).cast("long").alias("host"), nothing.alias("lam"), "convs", F.col("m").alias("first"),
                                                  nothing.alias("children"), nothing.alias("leaves"), nothing.alias("saved"), F.col("m").alias("ends"))
    root = _hung([turnless, *tops]).select(
        F.lit(None).cast("long").alias("m"), nothing.alias("depth"), F.lit(None).cast("long").alias("lam"), F.lit(None).cast("long").alias("host"), F.col("first").alias("conv_id"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.col("convs").alias("n_convs"), F.col("children").alias("n_children"),
        F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends")
    nodes = reduce(DataFrame.unionByName, levels, root)

    # the parent of a path's first node lies on its host
    first = (F.col("depth") == F.col("lam") + 1)
    hosts = nodes.select(F.col("m").alias("hm"), F.col("depth").alias("hd"), F.col("conv_id").alias("above"))
    led = nodes.where(first).join(hosts, F.col("host").eqNullSafe(F.col("hm")) & (F.col("lam") == F.col("hd"))).withColumn("parent_conv_id", F.col("above")).drop("hm", "hd", "above")
    nodes = nodes.where(first.isNull() | ~first).unionByName(led)
    empty = nodes.where("ends IS NULL").withColumn("ends_sha256", F.lit(sha256(b"").hexdigest()))
    ended = nodes.where("ends IS NOT NULL").join(named.select(F.col("m").alias("e"), "ends_sha256"), F.col("ends") == F.col("e")).drop("e")
    return empty.unionByName(ended).select(*NODES)
