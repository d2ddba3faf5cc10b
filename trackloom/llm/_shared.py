"""Where intermediate tables go, and column housekeeping the operators share."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OWN_FOLDER = "/tmp/trackloom-shared"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session that names none (a test) gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        folder = OWN_FOLDER
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/trackloom"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it again: lineage ends there, and a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    tidy(spark)
    return out


TIDY_SECONDS = 3.0
_tidied = [0.0]


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner see that finished queries' shuffle files are no longer referred to; not
    after each of many short steps, which leave little."""
    if time.monotonic() - _tidied[0] > TIDY_SECONDS:
        gc.collect()
        spark._jvm.System.gc()
        _tidied[0] = time.monotonic()


def discard(df: DataFrame) -> None:
    """Remove a settled table that no result reads any more."""
    path = getattr(df, "_settled_at", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names, so that extra columns of any name cannot clash."""
    return df.select(*[df[have].alias(name) for name, have in columns.items()])


def lower_az(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
