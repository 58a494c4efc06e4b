"""Connected components by alternating stars, in joins and groupings of the edges only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def hung(now: DataFrame) -> DataFrame:
    """The edges (a > b) of a round's end: larger neighbours hung on the smallest one, then smaller ones.

    Both sides of each join grow with the edges, so none is broadcast, and the plan is the same at every size.
    """
    both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    least = large.filter("a <> b").groupBy("a").agg(F.min("b").alias("m"))
    small = large.filter("a <> b").join(least.hint("merge"), "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    return small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches.

    Every round hangs each node's neighbours on the smallest of them, first the larger neighbours, then the smaller
    ones; rounds grow with the logarithm of the nodes. Neighbours are never gathered, only their minimum is.

    Edges of a node to itself or to null are left out, so a node without others has no row; repeated edges and both
    directions of one are one edge; columns other than a and b are left out; a node of very many edges is one key of each
    round's groupings and joins, streamed by one task where the engine doesn't split it; no edges give no rows.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/edges0")
    held, k = None, 0
    while True:
        k += 1
        now = written(hung(now), f"{folder}/edges{k}")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
        if state == held:
            break
        held = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
