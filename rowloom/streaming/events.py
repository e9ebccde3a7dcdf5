"""Event streams: windowed counts with late data, in batch and as a Structured Streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def window_counts(events: DataFrame, size: str = "1 hour", delay: str | None = None) -> DataFrame:
    """(start, event_type, n, total): the same plan for a batch and, with a watermark ``delay``, for a stream."""
    rows = events.withWatermark("ts", delay) if delay else events
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, n) of activity without a pause of ``gap``."""
    rows = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), "n")


def stream_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming plan over all that is there now and return its in-memory result table."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
