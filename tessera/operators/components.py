"""Connected components of a graph of any size, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpoint

#: Rounds after which something must be wrong; a path of n nodes takes about log2(n).
MOST_ROUNDS = 60


def clusters(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node in a pair; root is the smallest node that pairs lead to."""
    return connected_components(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge, where root is its component's smallest node.

    edges: columns u and v of one orderable type, without nulls; loops, repeated edges and either
    direction are fine. No edges give no rows. A node's neighbours are never gathered: each round
    takes minima by node and joins them back, so that a node with very many edges is pre-aggregated
    where its edges are and its join can be split. Each round ends in a checkpoint.
    """
    oriented = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = checkpoint(oriented)
    seen = _state(current)
    for _ in range(MOST_ROUNDS):
        if not seen[0]:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = checkpoint(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        before, seen = seen, _state(current)
        if before == seen:
            break
    else:
        raise RuntimeError("the components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    """Tells one set of edges from another."""
    row = edges.agg(F.count("*").alias("n"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)").alias("x")).first()
    return row.n, row.x
