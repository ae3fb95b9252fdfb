"""Connected components of an edge table, by alternating stars.

Each round hangs every node's larger neighbours, then its smaller ones, on its smallest neighbour; the
number of rounds grows with the logarithm of the longest path, and none is needed once all is stars. Sums combine on the map side, so a hub
with a third of all edges costs one row per task before the shuffle. Rounds are written to the shared
folder; the driver sees counts alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stars(now: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and none if it is one itself."""
    ends = now.select(F.col("u").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    return not ends.groupBy("x").agg(F.sum("a").alias("a"), F.max("b").alias("b")).where("a > 1 or a > 0 and b > 0").limit(1).count()


def components(edges: DataFrame, stage) -> DataFrame:
    """(node, label): the smallest node of each component, for every node that has an edge.

    ``edges`` has columns ``u`` and ``v`` of one ordered type; loops, repeats and nulls are ignored.
    ``stage(df, tag)`` writes a table and reads it back.
    """
    now = stage(edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), "cc")
    while not _stars(now):
        # u > v always. Large star: larger neighbours of a node go to its smallest neighbour or itself.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = now.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v"))
        # Small star: smaller neighbours of a node, and the node, go to the smallest.
        large = stage(large.where("u <> v"), "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stage(small.where("u <> v").distinct(), "cc")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
