"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a map-side combined minimum per node and an equi-join back, so no
task needs a node's whole neighbourhood. The minima are written before they are joined: counted as few they are broadcast, else the join
reads two plain shuffles, of which Spark splits a hub's. Each round is
written to the shared folder, which cuts the lineage. Rounds grow with the logarithm
of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored

MOST_ROUNDS = 60


def _with_least(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Directed (u, v) with m, the least of u and its neighbours; and the table (node, m) itself."""
    m = stored(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m")), "cc-least")
    return pairs.join(broadcast_if_small(m, m.count()), F.col("u") == F.col("node")), m


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its least reachable node), for the nodes that have edges."""
    now = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "cc-edges")
    state = None
    for _ in range(MOST_ROUNDS):
        # Large star: hang every larger neighbour on the least neighbour.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both)[0].filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = stored(large, "cc-large")
        # Small star: hang every smaller neighbour, and the node, on the least of them.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        joined, m = _with_least(down)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select(F.col("node").alias("u"), F.col("m").alias("v")))
        now = stored(small.filter("u <> v").distinct(), "cc-small")
        # Settled when a round leaves the same set of edges.
        was, state = state, tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first())
        if state[0] == 0 or state == was:
            break
    else:
        raise RuntimeError("components did not settle")
    tops = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
