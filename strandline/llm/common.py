"""Helpers shared by the training-data operators: table access, order, and the shared folder of the package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.shared import bounded_batches, clear_shared, materialise, shared_folder  # noqa: F401  used by the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_order(df: DataFrame, order: Column, name: str, text_col: str = "text") -> DataFrame:
    """df, written and read back, with distinct numbers that grow in the order.

    Rows that are equal in it are spread by their text and then by their place,
    so that no value of the order has to fit one task.
    """
    keyed = df.withColumn("_digest", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).withColumn("_place", F.monotonically_increasing_id())
    ordered = keyed.orderBy(order, "_digest", "_place").drop("_digest", "_place")
    return materialise(ordered.withColumn(name, F.monotonically_increasing_id()), "in-order")


def held(*columns: Column) -> list[Column]:
    """The columns, such that a filter on them stays above the projection that makes them.

    Pushed below, a filter would repeat the whole chain of expressions it
    stands on, and with nested ones that grows without bound.
    """
    always = F.monotonically_increasing_id() >= 0
    return [F.when(always, c) for c in columns]
