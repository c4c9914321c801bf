"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a min-aggregate per node and a join back on the node, so a hub of
any degree is pre-aggregated before its shuffle and split by AQE in the join; the
edge table shrinks towards one star per component.  Nothing reaches the driver
but two numbers a round (edge count and checksum).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return near.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (u, v); component is the smallest node of its component.

    Self-loops, repeated and reversed edges are allowed and change nothing; a node with only a self-loop is left out.
    """
    now = keep(edges.where("u <> v").select("u", "v").distinct())
    mark = None
    while True:
        size = now.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if size["n"] == 0 or (size["n"], size["h"]) == mark:
            break
        mark = size["n"], size["h"]
        now = keep(_small_star(_large_star(now).distinct()).where("u <> v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
