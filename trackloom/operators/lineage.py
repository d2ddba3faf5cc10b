"""Cutting lineage: checkpoints in the folder that the cluster names."""

import gc

from pyspark.sql import DataFrame, SparkSession

OWN_FOLDER = "/tmp/trackloom-checkpoints"


def folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; only a local session without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return (found or OWN_FOLDER).rstrip("/") + "/trackloom"


def cut(df: DataFrame) -> DataFrame:
    """The frame, written to the checkpoint folder, and read from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Let Spark's cleaner see that finished queries' shuffle files are no longer referred to."""
    gc.collect()
    spark._jvm.System.gc()
