"""Streams: new files of events or records, windows with watermarks, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema, files: int = 64) -> DataFrame:
    """Parquet files as they arrive, at most ``files`` in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def tumbling(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """Counts by window and key; rows later than ``late`` are dropped once their window closed."""
    df = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = df.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), key, "n")


def sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    df = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = df.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
