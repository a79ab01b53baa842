"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation and one join of the edges; stars flatten, so the number of
rounds grows with the logarithm of the longest path, and no node ever gathers its
neighbours. Edges are made distinct and written out once a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.llm.tables import stored


def _hung(edges: DataFrame) -> DataFrame:
    """(a, b, m) of the edges, m being the smallest of ``a`` and its neighbours."""
    low = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return edges.join(low, "a")


def _round(edges: DataFrame) -> DataFrame:
    """A large-star step, which hangs larger neighbours, and a small-star step, which hangs the smaller ones.

    Edges run from the larger node ``a`` to the smaller ``b``, before and after. The neighbour
    that is ``m`` hangs the node itself.
    """
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    large = _hung(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    small = _hung(large).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return small.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node reachable.

    Edges may repeat, run either way or join a node to itself; nodes of NULL are left out.
    """
    now = stored(edges.select("a", "b").where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    last = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == last:
            break
        last = tuple(mark)
        now = stored(_round(now), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
