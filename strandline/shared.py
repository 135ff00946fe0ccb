"""Intermediate tables in the folder that the cluster names in spark.checkpoint.dir, one subfolder for each run."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("strandline.local.dir", None) or tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("strandline.local.dir", root)
    return root.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The folder of this session, which no other session writes to or clears."""
    run = spark.conf.get("strandline.run", None)
    if run is None:
        run = f"{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
        spark.conf.set("strandline.run", run)
    return f"{_root(spark)}/strandline/{run}"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below that of this run.

    Only where spark.checkpoint.dir is unset, and only if the master is local, a temporary folder of this machine is taken.
    """
    return f"{run_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear_shared(spark: SparkSession) -> None:
    """Delete what this run wrote, once no result that reads it is needed; other runs' tables stay."""
    if spark.conf.get("strandline.run", None) is not None:
        delete(spark, run_folder(spark))


def bounded_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Bound the bytes of an Arrow batch, unless the session was given a bound: batches are counted in rows by default, and rows may be whole files."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(megabytes << 20))
