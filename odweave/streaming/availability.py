"""Availability series from a folder that snapshot files keep arriving in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = "time_stamp timestamp, cluster int"


def availability_stream(spark: SparkSession, path: str, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """(time_stamp, cluster, count) by event time; a window is final once the watermark has passed it."""
    rows = spark.readStream.schema(SNAPSHOT).parquet(path).withWatermark("time_stamp", late)
    counts = rows.groupBy(F.window("time_stamp", window).alias("w"), "cluster").agg(F.count("*").alias("count"))
    return counts.select(F.col("w.start").alias("time_stamp"), "cluster", "count")
