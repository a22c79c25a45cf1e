"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.storage import stage


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` for every node of an undirected edge table; the component is its smallest node.

    A round rewires each node's edges to its smallest neighbour; the number of rounds grows with the logarithm of the
    longest path. Each round is joins and aggregates over narrow rows, written to the shared folder, so that plans stay
    short and an executor's loss costs one round at most. Hubs are no single task's: minima are combined before the
    shuffle and the joins can be split. Null ends and self-loops make no edges; a node with no edges isn't listed.
    """
    a, b = F.col(src), F.col(dst)
    pairs = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(a.isNotNull() & b.isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    state = _state(pairs)
    while state[0]:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, state = state, _state(pairs)
        if state == before:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
