"""Connected components of an edge list by alternating large-star and small-star steps.

Each step is aggregations with map-side combine and joins; nothing is gathered
per node or sent to the driver, so a star with a third of all nodes is split as
any skewed join is. Each step's edges are written to the shared folder, which
also ends the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges point from the larger to the smaller node."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one root that points nowhere."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Columns node, root for the nodes of edges (u, v) that are not their own root.

    root is the smallest node of the component. Loops and repeated edges are
    allowed; without edges the result is empty.
    """
    u, v = F.col("u").cast("long"), F.col("v").cast("long")
    edges = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    while True:
        edges = materialise(_small_star(edges), "components")
        if _settled(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = _large_star(edges)
