"""Connected components of an edge table by alternating large and small stars.

Each round is two shuffles on node ids with pre-aggregated minima; nothing is
gathered at the driver but the count and hash sum that tell when edges have
stopped changing. A hub with very many edges is one key of a minimum, which
partial aggregation shrinks, and of a join, which is salted.
Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


#: Parts that a hub's edges are dealt into.
SALTS = 8


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the least node of its component."""
    edges = edges.select("u", "v").where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before, last = None, None
    while True:
        now = scratch.put(edges, "edges")
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(last)
        if mark == before or mark["n"] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        before, last = mark, now
        least = now.union(now.select("v", "u")).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: each edge's greater end goes to the least neighbour of its lesser end.
        hubs = least.select(F.col("u").alias("v"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        dealt = now.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
        large = dealt.join(hubs, ["v", "salt"]).select("u", F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        # Small star: each node and its lesser neighbours go to the least of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.union(least.select("u", F.col("m").alias("v"))).distinct()
