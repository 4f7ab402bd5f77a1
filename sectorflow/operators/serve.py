"""Batch scoring of cells and hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import calendar, cyclic_calendar
from .joins import nearest_hour


def serving_grid(cells: DataFrame, first_hour, hours: int = 1) -> DataFrame:
    """Each cell at each of the next hours."""
    start = F.lit(first_hour).cast("timestamp_ntz")
    return cells.select("cell").distinct().withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(hours - 1)))).select("cell", (start + F.make_dt_interval(hours=F.col("_h"))).alias("hour_ts"))


def serving_features(grid: DataFrame, obs: DataFrame, features: list[str]) -> DataFrame:
    """Observations of the exact hour, else the nearest of the cell, calendar and cyclic parts; features that are missing are 0."""
    near = nearest_hour(obs, grid, ["cell"])
    out = grid.join(near, ["cell", "hour_ts"], "left").withColumns(calendar(F.col("hour_ts"))).withColumns(cyclic_calendar(F.col("hour_ts")))
    weather = [c for c in near.columns if c not in ("cell", "hour_ts")]
    out = out.withColumn("has_weather_data", F.coalesce(F.greatest(*[F.col(c).isNotNull().cast("int") for c in weather], F.lit(0)), F.lit(0)))
    return out.withColumns({f: F.coalesce(F.col(f), F.lit(0)) if f in out.columns else F.lit(0.0) for f in features})


def score(model, rows: DataFrame, name: str = "champion") -> DataFrame:
    """cell, target_hour, predicted_incidents (never below 0), has_weather_data, model_name, prediction_timestamp."""
    from .train import predict

    return predict(model, rows).select("cell", F.col("hour_ts").alias("target_hour"), F.col("yhat").alias("predicted_incidents"), "has_weather_data", F.lit(name).alias("model_name"), F.current_timestamp().alias("prediction_timestamp"))


def top_hotspots(scored: DataFrame, k: int = 10) -> DataFrame:
    return scored.orderBy(F.desc("predicted_incidents"), "cell").limit(k)
