"""Connected components by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.sources.work import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star step and one small-star step on edges (u, v) with u > v; u is linked to ever smaller v.

    The least neighbour of a node is found by an aggregation and joined to its edges, so no neighbourhood is gathered.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = stored(large.where("u > v").distinct(), "large")
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of the edges (x, y), the least node that it is connected with."""
    pairs = edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u > v")
    pairs = stored(pairs.distinct(), "edges")
    state = _state(pairs)
    while True:
        pairs = _stars(pairs)
        last, state = state, _state(pairs)
        if state == last:
            break
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
