"""Connected components of a graph that is too large for one machine.

Large-star and small-star rounds (Kiveris et al., 2014) over a table of edges: each round points
nodes at smaller ones until every node points at the smallest of its component. A node with very
many edges is only ever grouped by a minimum, which is pre-aggregated before the shuffle. Few edges
are kept in few partitions, so that a round over them costs few tasks and files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

MOST_ROUNDS = 60
#: Edges of a partition.
PART_EDGES = 500_000


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: (a, b) of one comparable type. Returns (node, component), component the smallest
    node; nodes without edges are not in it."""
    pairs = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(pairs)
    for _ in range(MOST_ROUNDS):
        few = max(1, -(-state[0] // PART_EDGES))
        before, pairs = state, checkpointed(_small_star(_large_star(pairs.coalesce(few), few), few).coalesce(few))
        state = _state(pairs)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(pairs: DataFrame) -> tuple:
    """(edges, sum of their hashes): tells whether a round changed anything."""
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(pairs: DataFrame, few: int) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(few).distinct().coalesce(few)


def _small_star(pairs: DataFrame, few: int) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).coalesce(few)
    linked = pairs.join(least, "u")
    return linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).coalesce(few).distinct()
