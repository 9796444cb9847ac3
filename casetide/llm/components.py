"""Connected components of an edge table by alternating star contraction.

Each round replaces every edge by edges to the least neighbour (large star, then small star). All steps are
grouped minima, which combine map-side, and joins on the node, which adaptive execution splits where a node is
hot. Rounds grow with the logarithm of the longest chain, and end when every node hangs from its root. The
edges are written to the shared folder after each round, so lineage stays short and a lost executor costs one
round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _to_least(arcs: DataFrame, only_larger: bool) -> DataFrame:
    """``arcs`` (u, v), v a neighbour of u: an edge from each neighbour to the least of u and its neighbours."""
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = arcs.join(least, "u")
    if only_larger:
        return moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def _is_star_forest(pairs: DataFrame) -> bool:
    """Whether every node is either a root or has one parent, which is a root."""
    sides = pairs.select(F.col("u").alias("node"), F.col("v").alias("parent"), F.lit(0).alias("is_root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(1).alias("is_root"))
    )
    nodes = sides.groupBy("node").agg(F.min("parent").alias("a"), F.max("parent").alias("b"), F.max("is_root").alias("is_root"))
    return not nodes.where("a < b OR (is_root = 1 AND a IS NOT NULL)").limit(1).count()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of an edge, the least node it can reach. Loops and repeats are allowed."""
    pairs = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    while not _is_star_forest(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, only_larger=True).where("u > v")
        pairs = materialize(_to_least(large, only_larger=False).where("u > v").distinct())
    roots = pairs.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
