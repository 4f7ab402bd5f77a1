"""From raw tables to clean ones: names, locations, types, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digest import digest

#: Source names of the event and observation columns, in order of preference.
EVENT_NAMES = {"incident_id": ["traffic_report_id", "incident_number"], "timestamp": ["published_date", "published_datetime"], "description": ["issue_reported"], "lat": ["latitude"], "lon": ["longitude"], "status": ["traffic_report_status"]}
#: Columns that are no features.
ARTIFACTS = ["location", "location_lon", "location_lat", "traffic_report_status_date_time", "weather_h3_cell", "weather_combined_score", "weather_short_forecast", "weather_detailed_forecast", "h3_cell", "incident_id"]


def standardise(df: DataFrame, names: dict[str, list[str]] = EVENT_NAMES) -> DataFrame:
    """Rename by the table; where two sources go to one name, the first that is not null."""
    out, used = {}, set()
    for target, sources in names.items():
        have = [c for c in [target, *sources] if c in df.columns]
        if have:
            out[target] = F.coalesce(*have)
            used |= set(have) - {target}
    return df.withColumns(out).drop(*used)


def flatten_location(df: DataFrame, column: str = "location") -> DataFrame:
    """location_type, location_lon, location_lat from a struct or its JSON text; missing lat and lon are filled from them."""
    if column not in df.columns:
        return df
    if df.schema[column].dataType.typeName() == "string":
        get = lambda path: F.get_json_object(column, path)
        kind, lon, lat = get("$.type"), get("$.coordinates[0]").try_cast("double"), get("$.coordinates[1]").try_cast("double")
    else:
        kind, lon, lat = F.col(f"{column}.type"), F.try_element_at(F.col(f"{column}.coordinates"), F.lit(1)), F.try_element_at(F.col(f"{column}.coordinates"), F.lit(2))
    out = df.withColumns({"location_type": kind, "location_lon": lon, "location_lat": lat})
    own = lambda c: F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")
    return out.withColumns({"lat": F.coalesce(own("lat"), "location_lat"), "lon": F.coalesce(own("lon"), "location_lon")})


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bad values become null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns if c in df.columns})


def timestamps(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return df.withColumn(column, F.try_to_timestamp(F.col(column).cast("string")).cast("timestamp_ntz"))


def first_columns(df: DataFrame) -> DataFrame:
    """Of columns with one name, the first."""
    seen, keep = set(), []
    for i, c in enumerate(df.columns):
        keep.append(c if c not in seen else f"_dup{i}")
        seen.add(c)
    return df.toDF(*keep).drop(*[c for c in keep if c.startswith("_dup")])


def clean_events(df: DataFrame) -> DataFrame:
    """Rename, flatten, coerce; rows without id or time go."""
    out = numbers(timestamps(flatten_location(standardise(first_columns(df)))), ["lat", "lon"])
    return out.dropna(subset=[c for c in ("incident_id", "timestamp") if c in out.columns])


def clean_observations(df: DataFrame) -> DataFrame:
    out = first_columns(df)
    skip = {"timestamp", "data_source"}
    return numbers(timestamps(out), [c for c in out.columns if c not in skip]).dropna(subset=["timestamp"])


def majority_fallback(df: DataFrame, lat_range=(25, 35), share: float = 0.5) -> DataFrame:
    """Where less than `share` of all rows have a plausible latitude, all coordinates come from location_lat and location_lon."""
    ok = F.coalesce(F.col("lat").between(*lat_range).cast("double"), F.lit(0.0))
    ratio = df.agg(F.avg(ok).alias("_ratio"))  # one row
    out = df.crossJoin(F.broadcast(ratio))
    swap = F.col("_ratio") < share
    return out.withColumns({"lat": F.when(swap, F.col("location_lat")).otherwise(F.col("lat")), "lon": F.when(swap, F.col("location_lon")).otherwise(F.col("lon"))}).drop("_ratio")


def bounding_box(df: DataFrame, lat=(25, 35), lon=(-100, -95)) -> DataFrame:
    return df.where(F.col("lat").between(*lat) & F.col("lon").between(*lon))


def drop_artifacts(df: DataFrame) -> DataFrame:
    return df.drop(*ARTIFACTS)


def dedupe(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first by `order`."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def between_days(df: DataFrame, start, end, column: str = "timestamp") -> DataFrame:
    return df.where(F.col(column).between(F.lit(start), F.lit(end)))


def union_all(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def arrays_to_rows(df: DataFrame, keep: list[str], arrays: list[str]) -> DataFrame:
    """Parallel arrays as rows; shorter ones are padded with null."""
    return df.select(*keep, F.explode(F.arrays_zip(*arrays)).alias("_z")).select(*keep, *[F.col(f"_z.{a}").alias(a) for a in arrays])


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same on every run."""
    return df.orderBy(digest(seed, key), key).limit(n)
