"""Whole layers: bronze to silver, the panel, its features and targets, rich features, event-level features.

All but the two that name a folder, and those that must know the levels of a category, are lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode, temporal
from ..functions.geo import HexGrid, valid_lat, valid_lon
from ..operators import clean, joins, panel, windows
from ..operators.ordered import exact_quantiles
from ..sources import readers, sinks

CATEGORICAL = ("weather_weather_code", "weather_data_source")
DIRECTION = "weather_wind_direction"


def bronze_to_silver(spark: SparkSession, bronze: str, silver: str, kind: str = "events", single_file: bool = False) -> dict:
    """All readable files of a bronze folder, cleaned, as one silver table, with its metadata beside it as JSON."""
    out = {"events": clean.clean_events, "observations": clean.clean_observations}[kind](readers.read_layer(spark, bronze))
    sinks.write_silver(out, silver, single_file)
    meta = sinks.metadata(spark.read.parquet(silver), kind=kind, source=bronze)
    sinks.write_json(spark, f"{silver.rstrip('/')}_metadata.json", meta)
    return meta


def with_cells(df: DataFrame, grid: HexGrid = HexGrid()) -> DataFrame:
    """cell from lat and lon; null where a coordinate is missing, out of range or exactly 0."""
    return df.withColumn("cell", grid.cell(valid_lat(F.col("lat"), True), valid_lon(F.col("lon"), True)))


def base_panel(events: DataFrame, obs: DataFrame, ts: str = "timestamp", tie: str | None = None) -> DataFrame:
    """The (cell, hour) panel: roll-ups of both sides, their outer join, what is missing from the same hour of the city."""
    weather = panel.observations_by_hour(obs, ts, tie=tie)
    kinds = {f.name: f.dataType.typeName() for f in weather.schema}
    names = [c for c in kinds if c.startswith("weather_")]
    text = [c for c in names if kinds[c] in ("string", "boolean") or c in CATEGORICAL]
    return panel.impute_by_hour(panel.outer_join(panel.events_by_hour(events, ts), weather), [c for c in names if c not in text], text)


def _encoded(df: DataFrame, levels: dict[str, list] | None) -> DataFrame:
    """Weather flag, wind components and one-hot columns; the categories' levels are looked up where they are not given."""
    weather = [c for c in df.columns if c.startswith("weather_")]
    have = [c for c in CATEGORICAL if c in weather]
    levels = levels if levels is not None else {c: encode.categories(df, c) for c in have}
    out = df.withColumn("has_weather_data", F.col(weather[0]).isNotNull().cast("int")) if weather else df
    if "weather_is_daytime" in weather:
        out = out.withColumn("weather_is_daytime", encode.flag(F.col("weather_is_daytime")))
    if DIRECTION in weather:
        out = out.withColumns(temporal.wind_components(F.col(DIRECTION))).drop(DIRECTION)
    for c in have:
        out = encode.one_hot(out, c, levels[c])
    return out


def model_features(df: DataFrame, levels: dict[str, list] | None = None) -> DataFrame:
    """X of the panel: calendar on the circle, encoded weather, no count."""
    return _encoded(df.withColumns(temporal.cyclic_calendar(F.col("hour_ts"))), levels).drop("incident_count")


def targets(df: DataFrame, horizon: int = 1, mode: str = "row") -> DataFrame:
    """y of the panel: the count now and `horizon` on; null at the end of each cell."""
    return panel.lead_target(df.select("cell", "hour_ts", "incident_count"), horizon=horizon, mode=mode).drop("incident_count")


def rich_features(df: DataFrame, columns: list[str], lags=windows.LAGS, widths=windows.WIDTHS, stats=("mean", "max"), extras: bool = False, days: DataFrame | None = None, grid: HexGrid | None = None) -> DataFrame:
    """The panel with day bins, further calendar, lags and rolling statistics of `columns`.

    extras: volatility, trends, hour of the week and precipitation flags too. days: a table of holidays, for their flags.
    grid: same-hour aggregates over the neighbours of each cell. All windows share one partitioning and order: one sort.
    """
    ts, hour = F.col("hour_ts"), F.hour("hour_ts")
    out = df.withColumns({"time_of_day_bucket": temporal.time_of_day_bucket(hour), "rush_hour": temporal.rush_hour(hour), "day_period": temporal.day_period(ts)} | temporal.extended_calendar(ts))
    if days is not None:
        out = temporal.holiday_flags(out, "hour_ts", days)
    if grid is not None:
        out = joins.neighbor_aggregates(out, columns, grid)
    if extras:
        out = out.withColumns(temporal.cyclic(temporal.hour_of_week(ts), 168, "hour_of_week"))
        rain, chance = (f"weather_{c}" for c in panel.MAXIMA)
        if rain in df.columns:
            p90 = exact_quantiles(df.select(F.coalesce(rain, F.lit(0.0)).alias("x")), "x", [0.9])[0]
            odds = F.col(chance) if chance in df.columns else F.lit(0.0)
            out = out.withColumns(encode.precipitation_flags(F.col(rain), odds, F.lit(p90)))
    out = windows.rolling_rows(windows.lags(out, columns, lags), columns, widths, stats)
    if extras:
        long = tuple(w for w in widths if w >= 6)
        out = windows.trend(windows.volatility(out, columns, long), columns, long)
    return out


def event_features(df: DataFrame, ts: str = "timestamp", levels: dict[str, list] | None = None) -> DataFrame:
    """X of single events with their weather: calendar, encoded weather, without what is no feature."""
    out = df.withColumns(temporal.calendar(F.col(ts))).withColumns(temporal.cyclic_calendar(F.col(ts)))
    return clean.drop_artifacts(_encoded(out, levels))


def category_target(df: DataFrame, text: str = "description", key: str = "incident_id") -> DataFrame:
    """The classification target of single events: id, text, class and how sure it is."""
    label, sure = encode.classify(F.col(text))
    return df.select(F.col(key).alias("incident_id"), F.col(text).alias("description"), label.alias("incident_category"), sure.alias("incident_category_confidence"))
