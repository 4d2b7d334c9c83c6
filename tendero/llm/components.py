"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendero.llm.tables import written


def _mins(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, and beside it the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _mins(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge points from the larger end to the smaller one, here and in the result."""
    mins = _mins(edges)
    moved = mins.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(mins.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every end of a link; the component is its smallest node.

    Alternating stars: each round links all neighbours of a node to the smallest of them, until
    every node points at its component. Rounds grow with the logarithm of the longest
    path; each is written to the shared folder. Links with a null end are ignored.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = written(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "links")
    print_of = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum((F.col("u") != F.col("v")).cast("long")))
    before = None
    while (now := edges.agg(print_of.alias("s")).first()["s"]) != before:
        before = now
        edges = written(_small_star(_large_star(edges)), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", "v")).distinct()
