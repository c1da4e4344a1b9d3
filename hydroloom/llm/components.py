"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroloom.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """`u, v` for every node but the smallest of its component: `v` is that smallest node.

    Each round is two joins; a minimum is taken before the shuffle, and hot nodes meet it in joins that adaptive execution
    splits. Rounds grow with the logarithm of the longest path; they end when the edges no longer change.
    """
    own = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    held = cut_lineage(own, "component-edges")
    # A node with many smaller neighbours keeps one of them first, and these are linked to each other: rounds then start from
    # about one edge a node instead of one for every place where a node was linked.
    held = cut_lineage(_small_star(held), "component-edges", held)
    before = _state(held)
    while before[0]:
        held = cut_lineage(_small_star(_large_star(held)), "component-edges", held)
        after = _state(held)
        if after == before:
            break
        before = after
    return held
