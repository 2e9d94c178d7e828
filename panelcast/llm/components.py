"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v") % 2**40), F.lit(0))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(id, root) of every node with an edge: root is the smallest id that can be reached. edges: a, b.

    Every round is a few aggregations by node (combined before the shuffle) and joins; the number of rounds grows with the logarithm of the graph.
    """
    spark = edges.sparkSession
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(joined.union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        was, state = state, _state(now)
        if was == state:
            break
    if not state[0]:
        return spark.createDataFrame([], "id bigint, root bigint")
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
