"""Connected components of a graph given as edges, in rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.session import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): the smallest node that can be reached.

    Large and small stars in turn: each node hands its larger neighbours, then its smaller ones, to the smallest node
    that it knows.  Edges only ever become fewer or point to smaller nodes, and the number of rounds grows with the
    logarithm of the longest way.  Rounds end when nothing changes; each is written to the shared folder.
    """
    now = settle(edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("least"))
        handed = large.join(small, "a").filter(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        now = settle(handed.unionByName(small.select("a", F.col("least").alias("b"))).distinct())
        told = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = told
