"""Sources: Parquet layers, paged HTTP records, hourly observation payloads, caches."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.clean import between_days, dedupe


def read_layer(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """All files of a pattern, columns by name; unreadable files are skipped, which Spark logs."""
    return spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", True).option("pathGlobFilter", pattern).parquet(folder)


def read_days(spark: SparkSession, folder: str, first, last) -> DataFrame:
    """A date-partitioned layer, only the partitions asked for."""
    return spark.read.parquet(folder).where(F.col("date").between(F.lit(first), F.lit(last)))


def _get(url: str) -> str:
    from urllib.request import urlopen

    with urlopen(url, timeout=60) as r:  # noqa: S310
        return r.read().decode()


def page_urls(base: str, pages: int, limit: int = 1000, where: str | None = None, order: str | None = None) -> list[str]:
    from urllib.parse import urlencode

    extra = {k: v for k, v in (("$where", where), ("$order", order)) if v}
    return [f"{base}?{urlencode({'$limit': limit, '$offset': k * limit} | extra)}" for k in range(pages)]


def fetch_records(spark: SparkSession, urls: list[str], schema, get: Callable[[str], str] = _get) -> DataFrame:
    """Records of JSON pages, a task for each page; `get` maps a URL to its text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for u in b.column(0).to_pylist():
                rows = [json.dumps(r) for r in json.loads(get(u))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(rows)], ["json"])

    raw = spark.createDataFrame([(u,) for u in urls], "url string").repartition(max(1, len(urls))).mapInArrow(run, "json string")
    return raw.select(F.from_json("json", schema).alias("r")).select("r.*")


#: Hourly fields that are asked for.
HOURLY = ("temperature_2m", "relative_humidity_2m", "dewpoint_2m", "wind_speed_10m", "wind_direction_10m", "precipitation", "precipitation_probability", "weather_code")


def weather_urls(base: str, places: list[tuple[float, float]], first, last, fields=HOURLY) -> list[str]:
    """A request for each place: hourly fields of a range of days, in UTC."""
    from urllib.parse import urlencode

    return [f"{base}?{urlencode({'latitude': lat, 'longitude': lon, 'start_date': first, 'end_date': last, 'hourly': ','.join(fields), 'timezone': 'UTC'}, safe=',')}" for lat, lon in places]


def fetch_payloads(spark: SparkSession, urls: list[str], places: list[tuple[float, float]], fields, get: Callable[[str], str] = _get) -> DataFrame:
    """(lat, lon, hourly) of one payload a place, a task for each; a place whose request fails or is empty has no row."""
    arrays = "struct<time: array<string>, " + ", ".join(f"{f}: array<string>" for f in fields) + ">"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for u, lat, lon in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    hourly = json.loads(get(u)).get("hourly") or {}
                except (OSError, ValueError):
                    continue
                if hourly.get("time"):
                    yield pa.RecordBatch.from_arrays([pa.array([lat]), pa.array([lon]), pa.array([json.dumps({"hourly": hourly})])], ["lat", "lon", "json"])

    rows = [(u, float(a), float(o)) for u, (a, o) in zip(urls, places, strict=True)]
    raw = spark.createDataFrame(rows, "url string, lat double, lon double").repartition(max(1, len(rows))).mapInArrow(run, "lat double, lon double, json string")
    return raw.select("lat", "lon", F.from_json("json", f"hourly {arrays}").alias("p")).select("lat", "lon", "p.hourly")


def fetch_places(spark: SparkSession, archive: str, forecast: str, places: list[tuple[float, float]], first, last, now, fields=HOURLY, get: Callable[[str], str] = _get) -> DataFrame:
    """Hourly rows of all places: history before `now`, forecast from then on, each by its own service."""
    sides = [observations_from_payload(fetch_payloads(spark, weather_urls(base, places, first, last, fields), places, fields, get), list(fields), name) for base, name in ((archive, "historical"), (forecast, "forecast"))]
    return historical_and_forecast(*sides, now)


def fetch_recent(spark: SparkSession, base: str, schema, start, end, limit: int = 10_000, page: int = 2000, order: str = "published_date DESC", ts: str = "published_date", key: str = "incident_id", get: Callable[[str], str] = _get) -> DataFrame:
    """Records within [start, end], newest first by pages, one for each key. Paging is one request after the other, since each
    tells whether the next is needed: it ends at `limit` records, an empty page, or one with a record older than `start`."""
    from urllib.parse import urlencode

    held, at = [], 0
    while at < limit:
        n = min(page, limit - at)
        some = json.loads(get(f"{base}?{urlencode({'$limit': n, '$offset': at, '$order': order})}"))
        if not some:
            break
        held += some  # `limit` records at most
        at += n
        if min((str(r.get(ts)) for r in some if r.get(ts) is not None), default=str(start)) < str(start):
            break
    raw = spark.createDataFrame([(json.dumps(r),) for r in held], "json string").select(F.from_json("json", schema).alias("r")).select("r.*")
    return recent(raw, str(start), str(end), key, ts)


def recent(df: DataFrame, start, end, key: str = "incident_id", ts: str = "timestamp") -> DataFrame:
    """Rows within [start, end], one for each key, the latest."""
    return dedupe(between_days(df, start, end, ts), [key], F.col(ts).desc(), F.xxhash64(*df.columns))


def observations_from_payload(payloads: DataFrame, fields: list[str], source: str, column: str = "hourly") -> DataFrame:
    """Hourly payloads of parallel arrays (`time` and the fields) as rows with a source tag; uneven arrays are padded, bad numbers null."""
    z = F.explode(F.arrays_zip(*[F.col(f"{column}.{f}").alias(f) for f in ["time", *fields]])).alias("z")
    out = payloads.select("lat", "lon", z).select("lat", "lon", F.try_to_timestamp(F.col("z.time").cast("string")).cast("timestamp_ntz").alias("timestamp"), *[F.col(f"z.{f}").try_cast("double").alias(f) for f in fields])
    return out.where("timestamp is not null").withColumn("data_source", F.lit(source))


def historical_and_forecast(historical: DataFrame, forecast: DataFrame, now, ts: str = "timestamp") -> DataFrame:
    """History before `now`, forecast from then on, without repeated rows."""
    return historical.where(F.col(ts) < F.lit(now)).unionByName(forecast.where(F.col(ts) >= F.lit(now)), allowMissingColumns=True).dropDuplicates()


def cached(spark: SparkSession, folder: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table kept as Parquet under its key; built where it is not there yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{key}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        build().write.mode("overwrite").parquet(f"{folder}/{key}")
    return spark.read.parquet(f"{folder}/{key}")


def location_key(lat: float, lon: float, first, last, digits: int = 2) -> str:
    return f"{round(lat, digits)}_{round(lon, digits)}_{first}_{last}"


class FileStore:
    """(time, value) by key as JSON files in a folder: the slower tier of a TtlCache, kept between processes. The folder is the
    driver's, as the service's memory is."""

    def __init__(self, folder: str):
        from pathlib import Path

        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def _path(self, key):
        import hashlib

        return self.folder / f"{hashlib.sha256(str(key).encode()).hexdigest()}.json"

    def __contains__(self, key) -> bool:
        return self._path(key).exists()

    def __getitem__(self, key):
        return tuple(json.loads(self._path(key).read_text()))

    def __setitem__(self, key, value) -> None:
        part = self._path(key).with_suffix(".part")
        part.write_text(json.dumps(value))
        part.replace(self._path(key))


class TtlCache:
    """Values in memory for a while, then from a slower store (a dict or a FileStore), then from their source."""

    def __init__(self, source: Callable, store: dict | None = None, seconds: float = 3600, clock: Callable[[], float] = time.time):
        self.source, self.store, self.seconds, self.clock, self.memory = source, {} if store is None else store, seconds, clock, {}

    def get(self, key):
        now = self.clock()
        for tier in (self.memory, self.store):
            if key in tier and now - tier[key][0] <= self.seconds:
                self.memory[key] = tier[key]
                return tier[key][1]
        self.memory[key] = self.store[key] = (now, self.source(key))
        return self.memory[key][1]


def latest_partitioned(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """The newest row of each location."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("lat", "lon").orderBy(F.desc(ts)))).where("_n = 1").drop("_n")
