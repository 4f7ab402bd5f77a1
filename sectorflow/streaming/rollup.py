"""Hourly counts of a stream of events, late ones up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, ts: str = "ts", cell: str = "cell", late: str = "2 hours") -> DataFrame:
    """(cell, hour_ts, incident_count) of a streaming or plain table; on a stream, hours close `late` behind the newest event."""
    src = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    src = src.withWatermark("_ts", late) if events.isStreaming else src
    out = src.groupBy(F.window("_ts", "1 hour").alias("w"), cell).agg(F.count("*").alias("incident_count"))
    return out.select(cell, F.col("w.start").cast("timestamp_ntz").alias("hour_ts"), "incident_count")


def run_available(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, pattern: str = "*.parquet") -> None:
    """All files there are, then stop; the checkpoint remembers what has been read."""
    src = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    q = hourly_counts(src).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
