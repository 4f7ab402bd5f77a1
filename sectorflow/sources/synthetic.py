"""A synthetic panel: every cell at every hour, seasonal weather, Poisson incidents, hotspots."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.digest import uniform as _u
from ..functions.encode import dew_point
from ..functions.geo import HexGrid


@dataclass(frozen=True)
class Config:
    days: int = 90
    cells: int = 200
    seed: int = 42
    start: str = "2024-01-01"
    hotspot_share: float = 0.1
    base_rate: float = 0.05
    grid: HexGrid = HexGrid()


def disk(spark: SparkSession, cells: int) -> DataFrame:
    """(cell): the `cells` cells nearest to the origin, ring by ring."""
    k = math.ceil(math.sqrt(cells / 3))
    axis = spark.range(-k, k + 1)
    q, r = axis.select(F.col("id").alias("q")), axis.select(F.col("id").alias("r"))
    ring = F.greatest(F.abs("q"), F.abs("r"), F.abs(F.col("q") + F.col("r")))
    return q.crossJoin(r).withColumn("ring", ring).where(F.col("ring") <= k).orderBy("ring", "q", "r").limit(cells).select(HexGrid.pack(F.col("q"), F.col("r")).alias("cell"))


def _hour() -> Column:
    """The hour as a number: how a time is written does not matter to the digest."""
    return F.floor(F.unix_seconds(F.col("hour_ts").cast("timestamp")) / 3600)


def poisson(rate, u, most: int = 12):
    """Inverse distribution function of a Poisson count, up to `most`."""
    total, p, n = F.exp(-rate), F.exp(-rate), F.lit(0)
    for k in range(1, most + 1):
        n = n + (u > total).cast("int")
        p = p * rate / k
        total = total + p
    return n


def panel(spark: SparkSession, c: Config = Config()) -> DataFrame:
    """cell, hour_ts, weather_*, is_hotspot_cell, incident_count and target (that of the next hour)."""
    hours = spark.range(c.days * 24).select((F.lit(c.start).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("hour_ts"))
    df = disk(spark, c.cells).crossJoin(hours).withColumn("is_hotspot_cell", (_u(c.seed, "cell") < c.hotspot_share).cast("int"))
    year, day = F.dayofyear("hour_ts") * (2 * math.pi / 365), F.hour("hour_ts") * (2 * math.pi / 24)
    normal = lambda s: F.sqrt(-2 * F.log(_u(c.seed + s, _hour()))) * F.cos(2 * math.pi * _u(c.seed + s + 1, _hour()))
    rain = _u(c.seed + 30, _hour()) < 0.1
    df = df.withColumns({
        "weather_temperature": 20 - 10 * F.cos(year) - 5 * F.cos(day) + 2 * normal(10),
        "weather_humidity": F.greatest(F.lit(10.0), F.least(F.lit(100.0), 60 + 15 * F.cos(day) + 8 * normal(20))),
        "weather_precipitation_amount": F.when(rain, -0.2 * F.log(_u(c.seed + 31, _hour()))).otherwise(0.0),
        "weather_precipitation_probability": F.when(rain, 50 + 50 * _u(c.seed + 32, _hour())).otherwise(30 * _u(c.seed + 33, _hour())),
    })
    df = df.withColumn("weather_dewpoint", dew_point(F.col("weather_temperature"), F.col("weather_humidity")))
    peak = F.when(F.hour("hour_ts").isin(7, 8, 17, 18), 2.0).otherwise(1.0)
    rate = c.base_rate * peak * F.when(F.col("is_hotspot_cell") == 1, 6.0).otherwise(1.0) * F.when(rain, 1.5).otherwise(1.0)
    df = df.withColumn("incident_count", poisson(rate, _u(c.seed + 40, "cell", _hour())).cast("long"))
    return df.withColumn("target", F.lead("incident_count").over(Window.partitionBy("cell").orderBy("hour_ts")))
