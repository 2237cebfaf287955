"""Connected components of an edge table, by alternating star contractions on DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m), m the least of u and all v of u. Sums are cut first, so that the join
    reads two plain exchanges and a node with very many edges can be split."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _state(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(hashed)).first())


def components(edges: DataFrame, settle: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(u, v) long edges -> (node, root): root is the least node of node's component.

    Nodes without edges are not returned; nulls and loops are ignored. Each round hangs every larger
    neighbour, then every smaller one, on the least neighbour, until only stars around the least
    nodes are left: O(log n) rounds in practice. All state is in tables; nothing is collected. ``settle``
    materialises a round's edges.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = settle(e)
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _lowest(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = settle(small.where("u <> v").distinct())
        state, before = _state(e), state
        if state == before:
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
