"""Connected components of molecules, by pointers that are shortened and written in each step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that spark.checkpoint.dir names; a local session without one takes a folder of its own."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="strandline-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def components(edges: DataFrame, group: str = "pdb_id") -> DataFrame:
    """group, node, component (its smallest node) for all nodes of the edges (group, i, j).

    Each step gives a node the least label of itself, its neighbours and the
    node its label names, until nothing changes; the last doubles the reach.
    """
    both = edges.select(group, F.col("i").alias("node"), F.col("j").alias("other"))
    both = checkpointed(both.union(both.select(group, "other", "node")).distinct())
    labels = checkpointed(both.groupBy(group, "node").agg(F.least(F.min("other"), F.col("node")).alias("component")))
    while True:
        seen = both.join(labels.select(group, F.col("node").alias("other"), "component"), [group, "other"]).groupBy(group, "node").agg(F.min("component").alias("near"))
        step = labels.join(seen, [group, "node"]).select(group, "node", "component", F.least("near", "component").alias("new"))
        jump = labels.select(group, F.col("node").alias("new"), F.col("component").alias("far"))
        nxt = step.join(jump, [group, "new"], "left").select(group, "node", F.least("new", F.coalesce("far", "new")).alias("next"), "component")
        nxt = checkpointed(nxt)
        if nxt.where("next <> component").isEmpty():
            return nxt.select(group, "node", "component")
        labels = nxt.select(group, "node", F.col("next").alias("component"))


def largest_component(nodes: DataFrame, group: str = "pdb_id") -> DataFrame:
    """Nodes of the component with most nodes in each group; of ties the one with the smallest name."""
    sizes = nodes.groupBy(group, "component").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("m"), "component")).alias("b")).select(group, F.col("b.component").alias("component"))
    return nodes.join(top, [group, "component"])
