"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge to a root at most, and no root has one: then the roots are those of the components."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("n"), F.min("up").alias("least")).where("n > 1 or n = 1 and least = 0").count() == 0


def _star(pairs: DataFrame, name: str, large: bool) -> DataFrame:
    """Neighbours v of u go to the smallest of u and its neighbours: the larger ones (large star), or the smaller ones and u (small star).

    Both sides of the join come from files, so that Spark can split a node with very many edges.
    """
    least = _shared.materialize(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), f"{name}-least")
    out = pairs.where("v > u" if large else "v < u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    out = _shared.materialize(out.where("u > v").distinct(), name)
    _shared.drop(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (longs, undirected). Returns node, root (the smallest node reachable) for every node that is no root.

    Each round writes its edges to the shared folder, so lineage stays short and
    a lost executor costs a reread. No edges give no rows.
    """
    now = _shared.materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "large-star", True)
        small = _star(large, "small-star", False)
        _shared.drop(now, large)
        now = small
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
