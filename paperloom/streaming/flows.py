"""Structured Streaming: file-drop documents and event windows. The batch forms give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", files: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(folder)


def _marked(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark, which needs times with a zone; a batch as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; rows later than `late` are dropped in a stream."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = _marked(events, late).groupBy(span.alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    grouped = _marked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop; exactly once over the checkpoint."""
    df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
