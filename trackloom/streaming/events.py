"""Windowed counts over an event stream, the same plan for streams and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(rows: DataFrame, late: str) -> DataFrame:
    """Streams with a watermark, which takes times with a zone."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if rows.isStreaming else rows


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and summed values by window and type; rows later than the watermark are dropped on streams."""
    e = _marked(events, late)
    out = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def progress(jobs: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The last state of each job on a stream of progress events."""
    e = _marked(jobs, late)
    return e.groupBy("job_id").agg(F.max_by("status", "ts").alias("status"), F.max("progress").alias("progress"))
