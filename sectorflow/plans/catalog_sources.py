"""Queries of sources, sinks, cleaning, cells, samples and audits, each beside the SQL that gives the same rows."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import functions as F

from ..functions import encode, temporal
from ..functions.digest import DIGITS
from ..functions.geo import valid_lat, valid_lon
from ..operators import audit, clean, evaluate, panel, splits, train, windows
from ..sources import readers, sinks, synthetic
from ..sources.made_up import HOURS, RECORDS, payload, records
from ..sources.folders import work_folder
from . import features
from .catalog import DIST, GAPS, GRID, HEX, LIKE, E, P, _gaps, query

DIGEST = lambda seed, *cols: "CAST('0x' || substr(md5(concat_ws('|', " + ", ".join([f"'{seed}'", *(f"CAST({c} AS VARCHAR)" for c in cols)]) + f")), 1, {DIGITS}) AS BIGINT)"


query("paged_records", f"SELECT range AS id, range / 2 AS half FROM range({RECORDS})")(
    lambda s, d: readers.fetch_records(s, readers.page_urls("mem://service/records", 3, 1000), "id long, half double", records))
MADE = f"(SELECT 'r' || (k // 2) AS incident_id, make_timestamp(2024, 1 + n // 672, 1 + n % 672 // 24, n % 24, 0, 0.0) AS published_date FROM (SELECT range AS k, {RECORDS} - 1 - range AS n FROM range({RECORDS})))"
query("recent_window", f"SELECT incident_id, max(published_date) AS published_date FROM {MADE} WHERE published_date BETWEEN TIMESTAMP '2024-04-01 05:00:00' AND TIMESTAMP '2024-04-12 12:00:00' GROUP BY 1")(
    lambda s, d: readers.fetch_recent(s, "mem://service/records", "incident_id string, published_date timestamp_ntz", "2024-04-01T05:00:00", "2024-04-12T12:00:00", page=100, get=records))
PLACES = [(30.0, -97.5), (31.5, -97.0), (30.25, -98.0)]
query("weather_of_places", f"""SELECT lat, lon, ts AS timestamp, lat + h + CASE WHEN ts >= TIMESTAMP '2024-01-02 06:00:00' THEN 100 ELSE 0 END AS temperature_2m, CASE WHEN ts >= TIMESTAMP '2024-01-02 06:00:00' THEN 'forecast' ELSE 'historical' END AS data_source
  FROM (SELECT *, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * h AS ts FROM (VALUES (30.0::DOUBLE, -97.5::DOUBLE), (30.25::DOUBLE, -98.0::DOUBLE)) p(lat, lon), (SELECT range AS h FROM range({HOURS})))""")(
    lambda s, d: readers.fetch_places(s, "mem://archive", "mem://service/forecast", PLACES, "2024-01-01", "2024-01-02", "2024-01-02 06:00:00", ("temperature_2m",), payload))


def _payloads(s, d):
    z = F.sort_array(F.collect_list(F.struct("ts", "event_id", "value")))
    hourly = F.struct(F.transform(z, lambda x: x["ts"].cast("string")).alias("time"), F.transform(z, lambda x: x["value"].cast("string")).alias("value"))
    return readers.observations_from_payload(E(s, d).groupBy("lat", "lon").agg(hourly.alias("hourly")), ["value"], "historical")


query("payload_rows", "SELECT round(lat, 6)::DOUBLE AS lat, round(lon, 6)::DOUBLE AS lon, ts AS timestamp, round(value, 6) AS value, 'historical' AS data_source FROM e")(_payloads)


@query("cached_table", "SELECT event_type, count(*) AS n FROM e GROUP BY ALL")
def _cached(s, d):
    folder = work_folder(s, "cache")
    readers.cached(s, folder, "types", lambda: E(s, d).groupBy("event_type").agg(F.count("*").alias("n")))
    return readers.cached(s, folder, "types", lambda: s.sql("SELECT raise_error('built twice')"))


@query("ttl_cache", "SELECT * FROM (VALUES (0::BIGINT, 0.0::DOUBLE), (1, 0.0), (2, 20.0), (3, 20.0), (4, 40.0)) t(step, fetched_at)")
def _ttl(s, d):
    """Asked at 0, 5, 20, then anew at 25 by another process with the same files, and at 40; values live 10 seconds."""
    now, folder, rows = [0.0], tempfile.mkdtemp(), []
    cache = readers.TtlCache(lambda k: now[0], readers.FileStore(folder), 10, lambda: now[0])
    for i, t in enumerate((0.0, 5.0, 20.0, 25.0, 40.0)):
        now[0] = t
        if i == 3:
            cache = readers.TtlCache(lambda k: now[0], readers.FileStore(folder), 10, lambda: now[0])
        rows.append((i, cache.get("place")))
    return s.createDataFrame(rows, "step long, fetched_at double")


@query("silver_files", "SELECT event_id, cell, round(value, 6) AS value FROM e")
def _silver(s, d):
    folder = work_folder(s, "silver")
    sinks.write_silver(E(s, d).select("event_id", "cell", "value"), folder, False, 1000)
    return readers.read_layer(s, folder)


@query("daily_partitions", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM e WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
def _daily(s, d):
    folder = work_folder(s, "days")
    sinks.write_by_date(E(s, d).select("event_id", "timestamp"), folder)
    sinks.write_by_date(E(s, d).select("event_id", "timestamp").where("to_date(timestamp) = '2024-01-06'"), folder)  # again: replaces its own day only
    return readers.read_days(s, folder, "2024-01-05", "2024-01-09").select("event_id", F.col("date").cast("string").alias("date"))


@query("metadata_file", "SELECT count(*) AS row_count, CAST(min(ts) AS VARCHAR) AS first, CAST(max(ts) AS VARCHAR) AS last, 'cell,event_type' AS key, 1.5::DOUBLE AS max_km FROM e")
def _metadata(s, d):
    path = work_folder(s, "metadata") + ".json"
    sinks.write_json(s, path, sinks.panel_metadata(E(s, d), ("cell", "event_type"), "ts", max_km=1.5))
    m = json.loads(sinks.read_text(s, path))
    return s.createDataFrame([(m["row_count"], *m["date_range"], ",".join(m["primary_key"]), m["merge_parameters"]["max_km"])], "row_count long, first string, last string, key string, max_km double")


query("target_distribution", "SELECT event_type, count(*) AS n FROM e GROUP BY ALL")(
    lambda s, d: s.createDataFrame(list(sinks.target_metadata(E(s, d), "event_type")["target_distribution"].items()), "event_type string, n long"))


@query("results_file", "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{c}', {repr('linear') if c == 'model_name' else 'NULL::VARCHAR'})" for i, c in enumerate(sinks.RESULTS)) + ") t(place, name, value)")
def _results(s, d):
    folder = work_folder(s, "results")
    sinks.write_results(s.createDataFrame([("linear",)], "model_name string"), folder)
    back = s.read.option("header", True).csv(folder)
    return s.createDataFrame([(i, c, v) for i, (c, v) in enumerate(back.first().asDict().items())], "place long, name string, value string")


def _raw(e):
    bad = F.col("event_id") % 5 == 0
    return e.select(F.when(~bad, F.col("event_id").cast("string")).alias("traffic_report_id"), F.col("ts").cast("string").alias("published_date"), F.col("value").cast("string").alias("latitude"))


@query("bronze_to_silver", "SELECT CAST(event_id AS VARCHAR) AS incident_id, ts AS timestamp, round(value, 6) AS lat FROM e WHERE event_id % 5 <> 0")
def _bronze(s, d):
    bronze, silver = work_folder(s, "bronze"), work_folder(s, "silver")
    _raw(E(s, d)).repartition(3).write.parquet(bronze)
    features.bronze_to_silver(s, bronze, silver)
    return s.read.parquet(silver).select("incident_id", "timestamp", "lat")


query("clean_observations", "SELECT ts AS timestamp, CASE WHEN event_id % 3 <> 0 THEN round(value, 6) END AS temperature, event_type AS data_source FROM e WHERE event_id % 5 <> 0")(
    lambda s, d: clean.clean_observations(E(s, d).select(F.when(F.col("event_id") % 5 == 0, "no time").otherwise(F.col("ts").cast("string")).alias("timestamp"), F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("temperature"), F.col("event_type").alias("data_source"))))
ODD = "CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 91 WHEN 2 THEN 'NaN'::DOUBLE WHEN 3 THEN NULL ELSE {c} END"
_odd = lambda c: F.when(F.col("event_id") % 6 == 0, F.lit(0.0)).when(F.col("event_id") % 6 == 1, F.lit(91.0)).when(F.col("event_id") % 6 == 2, F.lit(float("nan"))).when(F.col("event_id") % 6 == 3, F.lit(None)).otherwise(F.col(c))
query("valid_coordinates", f"SELECT event_id, CASE WHEN NOT isnan(x) AND x BETWEEN -90 AND 90 THEN round(x, 6) END AS lat, CASE WHEN NOT isnan(x) AND x BETWEEN -90 AND 90 AND x <> 0 THEN round(x, 6) END AS lat_not_0, CASE WHEN NOT isnan(y) AND y BETWEEN -180 AND 180 AND y <> 0 THEN round(y, 6) END AS lon_not_0 FROM (SELECT event_id, {ODD.format(c='lat')} AS x, {ODD.format(c='lon')} AS y FROM e)")(
    lambda s, d: E(s, d).select("event_id", valid_lat(_odd("lat")).alias("lat"), valid_lat(_odd("lat"), True).alias("lat_not_0"), valid_lon(_odd("lon"), True).alias("lon_not_0")))
query("numeric_columns", "SELECT event_id, cell, round(value, 6) AS value, CAST(value > 250 AS BIGINT) AS big FROM e")(
    lambda s, d: encode.without(encode.numeric_columns(E(s, d).select("event_id", "cell", "value", "event_type", "ts", "lat", F.col("lat").alias("flat_x"), (F.col("value") > 250).alias("big"))), "lat"))

query("cell_text", HEX + " SELECT event_id, lower(to_hex((hq + 1048576) * 2097152 + hr + 1048576)) AS text, (hq + 1048576) * 2097152 + hr + 1048576 AS back FROM h")(
    lambda s, d: E(s, d).select("event_id", GRID.to_hex(GRID.cell(F.col("lat"), F.col("lon"))).alias("text")).withColumn("back", GRID.from_hex(F.col("text"))))
query("cell_centroids", HEX + f" SELECT DISTINCT (hq + 1048576) * 2097152 + hr + 1048576 AS cell, round(hr * {1.5 * GRID.size_km!r} / 111.195 + 30.0, 2) AS lat, round((hq + hr / 2) * {3**0.5 * GRID.size_km!r} / {GRID.km_per_lon!r} - 97.9, 2) AS lon FROM h")(
    lambda s, d: (lambda c: c.select("cell", *[x.alias(n) for x, n in zip(GRID.centroid(F.col("cell"), 2), ("lat", "lon"), strict=True)]))(E(s, d).select(GRID.cell(F.col("lat"), F.col("lon")).alias("cell")).distinct()))
RING = "greatest(abs(q), abs(r), abs(q + r))"
query("cell_ring", HEX + f" SELECT DISTINCT (hq + 1048576) * 2097152 + hr + 1048576 AS cell, (hq + q + 1048576) * 2097152 + hr + r + 1048576 AS neighbor FROM h, (SELECT unnest(range(-2, 3)) AS q), (SELECT unnest(range(-2, 3)) AS r) WHERE {RING} = 2")(
    lambda s, d: E(s, d).select(GRID.cell(F.col("lat"), F.col("lon")).alias("cell")).distinct().select("cell", F.explode(GRID.neighbors(F.col("cell"), 2, True, False)).alias("neighbor")))
query("cell_disk", f"SELECT (q + 1048576) * 2097152 + r + 1048576 AS cell FROM (SELECT unnest(range(-9, 10)) AS q), (SELECT unnest(range(-9, 10)) AS r) ORDER BY {RING}, q, r LIMIT 200")(lambda s, d: synthetic.disk(s, 200))
query("hex_coverage", HEX + f""", n AS (SELECT hq, hr, hour_ts, count(*) AS incident_count FROM h GROUP BY ALL), c AS (SELECT hq, hr, hour(hour_ts) AS hod, avg(incident_count) AS yhat FROM n GROUP BY ALL),
  pr AS (SELECT n.hq, n.hr, n.hour_ts, c.yhat FROM n JOIN c ON c.hq = n.hq AND c.hr = n.hr AND c.hod = hour(n.hour_ts)),
  k AS (SELECT hour_ts, greatest(1, least(50, greatest(5, count(*) // 10))) AS k_t FROM pr GROUP BY ALL),
  rp AS (SELECT *, row_number() OVER (PARTITION BY hour_ts ORDER BY yhat DESC, (hq + 1048576) * 2097152 + hr) AS rk FROM pr),
  i AS (SELECT rp.hour_ts, hq, hr FROM rp JOIN k ON k.hour_ts = rp.hour_ts WHERE rk <= k_t)
  SELECT n.hour_ts, count(*) AS n_cells, count(*) FILTER (near) AS covered, round(count(*) FILTER (near) / count(*), 6) AS coverage, round(coalesce(sum(incident_count) FILTER (near), 0) / sum(incident_count), 6) AS weighted
  FROM (SELECT n.*, EXISTS (SELECT 1 FROM i WHERE i.hour_ts = n.hour_ts AND {DIST.format(a='i', b='n')} <= 1) AS near FROM n) n GROUP BY n.hour_ts""")(
    lambda s, d: (lambda p: evaluate.coverage(p.join(p.groupBy("cell", F.hour("hour_ts").alias("hod")).agg(F.avg("count").alias("yhat")).withColumnRenamed("cell", "_c"), (F.col("cell") == F.col("_c")) & (F.hour("hour_ts") == F.col("hod"))).select("cell", "hour_ts", "yhat"), p, grid=GRID))(
        E(s, d).groupBy(GRID.cell(F.col("lat"), F.col("lon")).alias("cell"), temporal.floor_hour(F.col("ts")).alias("hour_ts")).agg(F.count("*").alias("count"))))

query("sampled_rows", f"SELECT event_id, cell FROM e ORDER BY {DIGEST(42, 'event_id')}, event_id LIMIT 500")(lambda s, d: clean.sample_rows(E(s, d).select("event_id", "cell"), "event_id", 500))
query("cells_held_out", f"SELECT cell, hour_ts, {DIGEST(42, 'cell')} % 100 < 20 AS held_out FROM p")(lambda s, d: splits.hold_out_cells(P(s, d).select("cell", "hour_ts")))
query("permuted_values", f""", a AS (SELECT cell, hour_ts, value, row_number() OVER (ORDER BY {DIGEST(7, 'cell', 'hour_ts')}, cell, hour_ts) AS n FROM p), b AS (SELECT value AS value_permuted, row_number() OVER (ORDER BY {DIGEST(8, 'cell', 'hour_ts')}, cell, hour_ts) AS n FROM p)
  SELECT cell, hour_ts, round(value, 6) AS value, round(value_permuted, 6) AS value_permuted FROM a JOIN b USING (n)""")(
    lambda s, d: audit.permute(P(s, d).select("cell", "hour_ts", "value"), "value", ["cell", "hour_ts"]))
query("label_numbers", ", c AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM e WHERE ts < TIMESTAMP '2024-01-15' AND event_type <> 'view')) SELECT event_id, coalesce(i, -1) AS label, CASE WHEN i IS NOT NULL THEN e.event_type END AS back FROM e LEFT JOIN c USING (event_type)")(
    lambda s, d: (lambda e: (lambda known: e.select("event_id", encode.encode_labels(F.col("event_type"), known, -1).alias("label")).withColumn("back", F.when(F.col("label") >= 0, encode.decode_labels(F.col("label"), known))))(encode.fit_labels(e.where("ts < '2024-01-15' and event_type <> 'view'"), "event_type")))(E(s, d)))
query("zero_shot_documents", f"SELECT doc_id, CASE WHEN {LIKE(encode.KEYWORDS['CRASH'])} THEN 'CRASH' WHEN {LIKE(encode.KEYWORDS['HAZARDOUS CONDITION'])} THEN 'HAZARDOUS CONDITION' ELSE 'OTHER' END AS category FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")(
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", encode.zero_shot(F.col("text"))[0].alias("category")))
NAMES = [("value", "base", False), ("value_lag_3h", "lag", False), ("value_lag_-1h", "lag", True), ("value_rolling_std_6h", "rolling", False), ("incident_count_lag_1h", "lag", True), ("max_severity", "base", True), ("value_t_plus_1", "base", True), ("lag_time", "base", False)]
query("feature_list", "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{n}', '{k}', {str(x).lower()})" for i, (n, k, x) in enumerate(NAMES, 1)) + ") t(number, name, kind, suspicious)")(lambda s, d: train.list_features(s, [n for n, _, _ in NAMES]))
query("day_names", "SELECT event_id, strftime(ts, 'events_%Y-%m-%d') AS name, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM e")(
    lambda s, d: E(s, d).select("event_id", temporal.day_name(F.col("ts"), "events").alias("name")).withColumn("day", temporal.day_of_name(F.col("name")).cast("string")))
query("history_in_time", "SELECT a.cell, a.hour_ts, round(avg(b.value), 6) AS mean, round(stddev_samp(b.value), 6) AS std, round(min(b.value), 6) AS min, round(max(b.value), 6) AS max, count(b.value) AS n FROM p a JOIN p b ON b.cell = a.cell AND b.hour_ts BETWEEN a.hour_ts - INTERVAL 6 HOUR AND a.hour_ts GROUP BY ALL")(
    lambda s, d: audit.history_in_time(P(s, d), "value", 6, ["cell"]))
query("look_ahead_audit", "SELECT unnest(['value_lag_1h', 'value_lag_-1h', 'value_rolling_std_6h']) AS feature, count(*) AS checked FROM p GROUP BY 1")(
    lambda s, d: audit.audit_features(windows.rolling_rows(windows.lags(P(s, d), ["value"], (1, -1)), ["value"], (6,), ("std",)), ["value"], 1e-6).select("feature", "checked"))
query("look_ahead_found", "SELECT unnest(['value_lag_1h', 'value_lag_-1h']) AS feature, unnest([0, (SELECT count(*) - count(DISTINCT cell) FROM p)])::BIGINT AS mismatches")(
    lambda s, d: audit.audit_features(windows.lags(P(s, d), ["value"], (1, -1)), ["value"]).select("feature", "mismatches"))
query("city_hour_impute_first", GAPS + ", c AS (SELECT hour_ts, min_by(kind, cell) FILTER (kind IS NOT NULL) AS m FROM g2 GROUP BY ALL) SELECT cell, hour_ts, incident_count, round(value, 6) AS value, coalesce(kind, m) AS kind FROM g2 LEFT JOIN c USING (hour_ts)")(
    lambda s, d: panel.impute_by_hour(_gaps(s, d), [], ["kind"], first=True))
query("hour_means", "SELECT cell, hour_ts, round(avg(value), 6) AS value, min_by(event_type, (ts, event_id)) AS data_source FROM e GROUP BY ALL")(
    lambda s, d: panel.hour_means(E(s, d).withColumn("data_source", F.col("event_type")), ["value"], tie="event_id"))

U = lambda seed, *cols: f"(({DIGEST(seed, *cols)} + 0.5::DOUBLE) / 281474976710656)"
NORMAL = lambda seed: f"sqrt(-2 * ln({U(seed, 'h')})) * cos(6.283185307179586 * {U(seed + 1, 'h')})"
query("synthetic_panel", f""", c AS (SELECT (q + 1048576) * 2097152 + r + 1048576 AS cell FROM (SELECT unnest(range(-9, 10)) AS q), (SELECT unnest(range(-9, 10)) AS r) ORDER BY {RING}, q, r LIMIT 200),
  t AS (SELECT range AS i, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * range AS hour_ts, CAST(epoch(TIMESTAMP '2024-01-01') AS BIGINT) // 3600 + range AS h FROM range(2160)),
  w AS MATERIALIZED (SELECT *, {U(72, 'h')} < 0.1 AS rain, 20 - 10 * cos(dayofyear(hour_ts) * {2 * 3.141592653589793 / 365!r}) - 5 * cos(hour(hour_ts) * {2 * 3.141592653589793 / 24!r}) + 2 * {NORMAL(52)} AS temperature,
    greatest(10, least(100, 60 + 15 * cos(hour(hour_ts) * {2 * 3.141592653589793 / 24!r}) + 8 * {NORMAL(62)})) AS humidity, -0.2 * ln({U(73, 'h')}) AS wet, 50 + 50 * {U(74, 'h')} AS likely, 30 * {U(75, 'h')} AS hardly FROM t),
  g AS MATERIALIZED (SELECT cell, w.*, CAST({U(42, 'cell')} < 0.1 AS BIGINT) AS hot, {U(82, 'cell', 'h')} AS u FROM c, w),
  l AS MATERIALIZED (SELECT *, 0.05::DOUBLE * CASE WHEN hour(hour_ts) IN (7, 8, 17, 18) THEN 2.0 ELSE 1.0 END * CASE WHEN hot = 1 THEN 6.0 ELSE 1.0 END * CASE WHEN rain THEN 1.5 ELSE 1.0 END AS rate FROM g),
  f AS (SELECT *, CAST(list_sum(list_transform(range(0, 12), lambda k: CAST(u > exp(-rate) * list_sum(list_transform(range(0, k + 1), lambda j: pow(rate, j) / factorial(CAST(j AS INT)))) AS INT))) AS BIGINT) AS n FROM l)
  SELECT cell, hour_ts, hot AS is_hotspot_cell, round(temperature, 6) AS weather_temperature, round(humidity, 6) AS weather_humidity, CASE WHEN rain THEN round(wet, 6) ELSE 0 END AS weather_precipitation_amount, round(CASE WHEN rain THEN likely ELSE hardly END, 6) AS weather_precipitation_probability,
    round(temperature - (100 - humidity) / 5, 6) AS weather_dewpoint, n AS incident_count, lead(n) OVER (PARTITION BY cell ORDER BY hour_ts) AS target FROM f""")(lambda s, d: synthetic.panel(s))
