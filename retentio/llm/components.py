"""Connected components of an edge table by alternating star steps.

Every step is a grouped minimum (partially aggregated, so a hub costs one row
per task) and a join back (skewed hubs are split by adaptive execution).  Each
round is written to the shared checkpoint folder, so a lost executor re-reads
files and the plan never grows; nothing but one flag per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.session import cut_lineage


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v, m): every pair with the smallest of u and its partners."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(low, "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (_star(both).where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    s = _star(down)
    return (s.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                       F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of the undirected ``edges`` (u, v).

    ``root`` is the smallest node of the component.  NULL ends and self loops
    are ignored, repeated edges count once, no edges give no rows.
    """
    current = cut_lineage(edges.select("u", "v").where("u <> v").distinct())
    while not _stars(current):
        current = cut_lineage(_small_star(_large_star(current)))
    roots = current.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether the edges are stars around their smallest node: every u hangs on one smaller v, and no v on another."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs"), (F.col("u") <= F.col("v")).cast("int").alias("wrong")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(0).alias("wrong")))).alias("e"))
    seen = (ends.groupBy("e.node").agg(F.sum("e.hangs").alias("hangs"), F.min("e.hangs").alias("least"),
                                       F.max("e.wrong").alias("wrong")))
    return seen.where("hangs > 1 OR (hangs = 1 AND least = 0) OR wrong = 1").isEmpty()
