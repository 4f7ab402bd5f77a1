"""The test tables as sector events: user is the sector, value the observed metric, coordinates a small lattice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.temporal import floor_hour

SQL = """e AS (
  SELECT event_id, ts, date_trunc('hour', ts) AS hour_ts, user_id AS cell, event_type, value,
    30.0 + (user_id % 15) * 0.01 AS lat, -97.9 + (user_id // 15) * 0.01 AS lon, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
p AS (SELECT cell, hour_ts, count(*) AS incident_count, median(value) AS value FROM e GROUP BY cell, hour_ts)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.col("event_id").alias("incident_id"), "ts", F.col("ts").alias("timestamp"), F.col("user_id").alias("cell"), "event_type", F.col("event_type").alias("agency"), F.col("event_type").alias("status"), "value", (30.0 + (F.col("user_id") % 15) * 0.01).alias("lat"), (-97.9 + F.floor(F.col("user_id") / 15) * 0.01).alias("lon"), "props")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (cell, hour) panel. Both sides come from one table here, so one aggregate gives it."""
    e = events(spark, sf_dir).where("cell is not null")
    return e.groupBy("cell", floor_hour(F.col("ts")).alias("hour_ts")).agg(F.count("incident_id").alias("incident_count"), F.median("value").alias("value"))
