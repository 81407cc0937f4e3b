"""Connected components by alternating stars: every step is joins and aggregates over the edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.sources.scratch import Scratch


def state_of(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.expr("sum(cast(xxhash64(a, b) as decimal(38,0)))")).first()
    return tuple(row)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b) that is not the smallest itself.

    Large star: each node's larger neighbours move to its smallest neighbour; small star:
    its smaller neighbours do. A node's minimum is aggregated before the shuffle and
    joined back, so a node with very many neighbours is never gathered.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = scratch.written(pairs.distinct())
    state = state_of(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("low"))
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.filter("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a")
        small = small.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(lowest.select("a", F.col("low").alias("b")))
        current = scratch.written(small.distinct())
        reached = state_of(current)
        if reached == state:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = reached
