"""Connected components of an edge table, by alternating large and small stars.

Each round is a few group-bys and equi-joins over the edges; their number falls with the logarithm
of a component's length. A hot vertex's edges meet in partial aggregates and splittable joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root) for every vertex of ``edges`` (u, v: bigint, self-loops and repeats allowed); root is the least vertex reachable."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    seen, last = None, None
    while True:
        edges = materialize(edges, name)
        if last is not None:
            discard(last)  # the round that was made of it is stored whole
        last = edges
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if state == seen:
            break
        seen = state
        if not state[0]:
            break
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
