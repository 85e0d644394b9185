"""Connected components by alternating large and small stars: minima and joins only, no neighbour list is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MOST_ROUNDS = 60  # far beyond the logarithmic number of rounds that any graph needs


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u long, v long); the root is the component's least node."""
    now = common.cut(edges.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    mark = _mark(now)
    for _ in range(MOST_ROUNDS):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("b"), F.col("m").alias("a")).filter("a != b").distinct()
        # small star: each node's lesser neighbours meet at the least of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("u"), F.col("a").alias("v")).unionByName(low.select(F.col("m").alias("u"), F.col("b").alias("v")))
        now = common.cut(small.filter("u != v").distinct())
        before, mark = mark, _mark(now)
        if before == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """The number of edges and an order-free hash of them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
