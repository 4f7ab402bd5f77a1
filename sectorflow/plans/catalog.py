"""Queries of the engine over the test tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode, temporal
from ..functions.geo import HexGrid, haversine_km
from ..operators import audit, clean, evaluate, joins, panel, serve, splits, train, windows
from ..operators.ordered import exact_quantiles
from . import adapter, features

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
GRID = HexGrid()


def query(name: str, sql: str | None = None, digits: int = 6):
    def register(f):
        Q[name] = lambda spark, d: tidy(f(spark, d), digits)
        if sql:
            ORACLE[name] = f"WITH {adapter.SQL} {sql}" if not sql.lstrip().startswith(",") else f"WITH {adapter.SQL}{sql}"
        return f

    return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers as long, doubles to some decimals: so that both engines print the same. Means of 32 cents need more than 6."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.col(c).cast("long") for c, t in kinds.items() if t in ("int", "smallint", "tinyint")} | {c: F.round(c, digits) for c, t in kinds.items() if t == "double"})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog_models, catalog_sources  # noqa: F401  they register theirs

    return dict(Q)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLE)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Panel, next-row target, lags and rolling means, and each hour's top sectors."""
    p = panel.lead_target(adapter.panel(spark, d))
    p = windows.rolling_rows(windows.lags(p, ["value"], (1, 3)), ["value"], (3, 6))
    return tidy(windows.rank_in_hour(p, F.col("incident_count")).where("rank <= 10"))


E, P = adapter.events, adapter.panel

query("flagship_hotspots", """SELECT * FROM (
  SELECT cell, hour_ts, incident_count, round(value, 6) AS value, incident_count AS incident_count_t, lead(incident_count) OVER w AS incident_count_t_plus_1,
    round(lag(value, 1) OVER w, 6) AS value_lag_1h, round(lag(value, 3) OVER w, 6) AS value_lag_3h,
    round(avg(value) OVER (PARTITION BY cell ORDER BY hour_ts ROWS 2 PRECEDING), 6) AS value_rolling_mean_3h, round(max(value) OVER (PARTITION BY cell ORDER BY hour_ts ROWS 2 PRECEDING), 6) AS value_rolling_max_3h,
    round(avg(value) OVER (PARTITION BY cell ORDER BY hour_ts ROWS 5 PRECEDING), 6) AS value_rolling_mean_6h, round(max(value) OVER (PARTITION BY cell ORDER BY hour_ts ROWS 5 PRECEDING), 6) AS value_rolling_max_6h,
    row_number() OVER (PARTITION BY hour_ts ORDER BY incident_count DESC, cell) AS rank
  FROM p WINDOW w AS (PARTITION BY cell ORDER BY hour_ts)) WHERE rank <= 10""")(flagship)

CAL = "CAST(hour(hour_ts) AS BIGINT) AS hour, CAST(isodow(hour_ts) - 1 AS BIGINT) AS day_of_week, CAST(day(hour_ts) AS BIGINT) AS day_of_month, CAST(month(hour_ts) AS BIGINT) AS month, CAST(isodow(hour_ts) >= 6 AS BIGINT) AS is_weekend"

query("sector_hour_counts", f"SELECT *, {CAL} FROM (SELECT cell, hour_ts, count(event_id) AS incident_count, count(DISTINCT event_type) AS n_unique_agency, count(DISTINCT event_type) AS n_unique_status FROM e GROUP BY ALL)")(
    lambda s, d: panel.events_by_hour(E(s, d)))
query("sector_hour_weather", "SELECT cell, hour_ts, round(median(value), 6) AS weather_temperature, max(value) AS weather_precipitation_amount, min_by(event_type, (ts, event_id)) AS weather_data_source FROM e GROUP BY ALL")(
    lambda s, d: panel.observations_by_hour(E(s, d).withColumns({"temperature": F.col("value"), "precipitation_amount": F.col("value"), "data_source": F.col("event_type")}), tie="event_id"))
query("sector_hour_outer_join", f"""SELECT *, {CAL} FROM (SELECT coalesce(a.cell, b.cell) AS cell, coalesce(a.hour_ts, b.hour_ts) AS hour_ts, coalesce(n, 0) AS incident_count, round(v, 6) AS weather_value
  FROM (SELECT cell, hour_ts, count(*) AS n FROM e WHERE event_type IN ('error', 'click') GROUP BY ALL) a FULL JOIN (SELECT cell, hour_ts, median(value) AS v FROM e WHERE event_type = 'view' GROUP BY ALL) b ON a.cell = b.cell AND a.hour_ts = b.hour_ts)""")(
    lambda s, d: panel.outer_join(panel.events_by_hour(E(s, d).where("event_type in ('error', 'click')"), distinct=()).select("cell", "hour_ts", "incident_count"), panel.observations_by_hour(E(s, d).where("event_type = 'view'"), medians=("value",))))
query("dense_hour_grid", "SELECT cell, h AS hour_ts FROM (SELECT DISTINCT cell FROM p), (SELECT unnest(generate_series(min(hour_ts), max(hour_ts), INTERVAL 1 HOUR)) AS h FROM p)")(
    lambda s, d: panel.dense_grid(P(s, d)))


def _gaps(s, d):
    """The panel with values missing where the count is one and the hour odd."""
    return P(s, d).withColumn("value", F.when((F.hour("hour_ts") % 2 == 0) | (F.col("incident_count") > 1), F.col("value"))).withColumn("kind", F.when(F.col("value").isNotNull(), (F.floor(F.col("value")) % 3).cast("string")))


GAPS = ", g AS (SELECT cell, hour_ts, incident_count, CASE WHEN hour(hour_ts) % 2 = 0 OR incident_count > 1 THEN value END AS value FROM p), g2 AS (SELECT *, CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) AS kind FROM g)"
query("city_hour_impute_median", GAPS + " SELECT cell, hour_ts, incident_count, round(coalesce(value, m), 6) AS value, kind FROM g2 JOIN (SELECT hour_ts, median(value) AS m FROM g2 GROUP BY ALL) USING (hour_ts)")(
    lambda s, d: panel.impute_by_hour(_gaps(s, d), ["value"]))
query("city_hour_impute_mode", GAPS + """, c AS (SELECT hour_ts, kind AS m FROM (SELECT hour_ts, kind, row_number() OVER (PARTITION BY hour_ts ORDER BY count(*) DESC, kind) AS n FROM g2 WHERE kind IS NOT NULL GROUP BY hour_ts, kind) WHERE n = 1)
  SELECT cell, hour_ts, incident_count, round(value, 6) AS value, coalesce(kind, m) AS kind FROM g2 LEFT JOIN c USING (hour_ts)""")(
    lambda s, d: panel.impute_by_hour(_gaps(s, d), [], ["kind"]))
query("global_median_impute", GAPS + " SELECT cell, hour_ts, incident_count, round(coalesce(value, (SELECT median(value) FROM g2)), 6) AS value, kind FROM g2")(
    lambda s, d: panel.impute_global(_gaps(s, d), ["value"]))
query("train_median_impute", GAPS + ", t AS (SELECT median(value) AS m FROM g2 WHERE hour_ts < TIMESTAMP '2024-01-15') SELECT cell, hour_ts, incident_count, round(coalesce(value, m), 6) AS value, kind FROM g2, t WHERE hour_ts >= TIMESTAMP '2024-01-15'")(
    lambda s, d: panel.impute_global(_gaps(s, d).where("hour_ts >= '2024-01-15'"), ["value"], _gaps(s, d).where("hour_ts < '2024-01-15'")))

LEAD = "SELECT cell, hour_ts, incident_count, round(value, 6) AS value, incident_count AS incident_count_t"
query("next_hour_target", LEAD + ", lead(incident_count) OVER (PARTITION BY cell ORDER BY hour_ts) AS incident_count_t_plus_1 FROM p")(lambda s, d: panel.lead_target(P(s, d)))
query("horizon_targets", LEAD + ", lead(incident_count, 3) OVER (PARTITION BY cell ORDER BY hour_ts) AS incident_count_t_plus_3, lead(incident_count, 6) OVER (PARTITION BY cell ORDER BY hour_ts) AS incident_count_t_plus_6 FROM p")(
    lambda s, d: panel.lead_target(panel.lead_target(P(s, d), horizon=3), horizon=6))
query("next_hour_target_strict", "SELECT p.cell, p.hour_ts, p.incident_count, round(p.value, 6) AS value, p.incident_count AS incident_count_t, n.incident_count AS incident_count_t_plus_1 FROM p LEFT JOIN p n ON n.cell = p.cell AND n.hour_ts = p.hour_ts + INTERVAL 1 HOUR")(
    lambda s, d: panel.lead_target(P(s, d), mode="hour"))
query("drop_null_target", "SELECT * FROM (SELECT cell, hour_ts, lead(incident_count) OVER (PARTITION BY cell ORDER BY hour_ts) AS y FROM p) WHERE y IS NOT NULL")(
    lambda s, d: panel.lead_target(P(s, d)).where("incident_count_t_plus_1 is not null").select("cell", "hour_ts", F.col("incident_count_t_plus_1").alias("y")))

W = "PARTITION BY cell ORDER BY hour_ts"
query("lag_features", "SELECT cell, hour_ts, incident_count, round(value, 6) AS value, " + ", ".join(f"round(lag(value, {k}) OVER ({W}), 6) AS value_lag_{k}h, lag(incident_count, {k}) OVER ({W}) AS incident_count_lag_{k}h" for k in windows.LAGS) + " FROM p")(
    lambda s, d: windows.lags(P(s, d), ["value", "incident_count"]))
query("lag_features_strict", "SELECT p.cell, p.hour_ts, p.incident_count, round(p.value, 6) AS value, round(a.value, 6) AS value_lag_1h, round(b.value, 6) AS value_lag_24h FROM p LEFT JOIN p a ON a.cell = p.cell AND a.hour_ts + INTERVAL 1 HOUR = p.hour_ts LEFT JOIN p b ON b.cell = p.cell AND b.hour_ts + INTERVAL 24 HOUR = p.hour_ts")(
    lambda s, d: windows.lags(P(s, d), ["value"], (1, 24), "hour"))
ROLL = {"mean": "avg", "max": "max", "min": "min", "std": "stddev_samp"}
query("rolling_rows", "SELECT cell, hour_ts, incident_count, round(value, 8) AS value, " + ", ".join(f"round({f}(value) OVER ({W} ROWS {w - 1} PRECEDING), 8) AS value_rolling_{n}_{w}h" for w in windows.WIDTHS for n, f in ROLL.items()) + " FROM p", 8)(
    lambda s, d: windows.rolling_rows(P(s, d), ["value"], stats=tuple(ROLL)))
query("rolling_time", "SELECT event_id, cell, ts, value, " + ", ".join(f"round({f}(value) OVER (PARTITION BY cell ORDER BY ts RANGE BETWEEN INTERVAL '2:59:59.999999' PRECEDING AND CURRENT ROW), 6) AS value_rolling_{n}_3h" for n, f in ROLL.items()) + " FROM e")(
    lambda s, d: windows.rolling_time(E(s, d).select("event_id", "cell", "ts", "value"), "value", 3, "ts", ["cell"]))
query("rolling_volatility", "SELECT cell, hour_ts, incident_count, round(value, 6) AS value, " + ", ".join(f"round(stddev_samp(value) OVER ({W} ROWS {w - 1} PRECEDING) / (abs(avg(value) OVER ({W} ROWS {w - 1} PRECEDING)) + 1e-6), 6) AS value_rolling_cv_{w}h" for w in (6, 12, 24)) + " FROM p")(
    lambda s, d: windows.volatility(P(s, d), ["value"]))
query("rolling_trend", ", r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY hour_ts) AS rn FROM p) SELECT cell, hour_ts, incident_count, round(value, 6) AS value, " + ", ".join(f"CASE WHEN count(value) OVER ({W} ROWS {w - 1} PRECEDING) = {w} THEN round(regr_slope(value, rn) OVER ({W} ROWS {w - 1} PRECEDING) * ({w * (w * w - 1) / 12} / ({w * (w * w - 1) / 12} + 1e-6)), 6) END AS value_rolling_slope_{w}h" for w in (6, 12)) + " FROM r")(
    lambda s, d: windows.trend(P(s, d), ["value"], (6, 12)))
query("topk_stability", """, s AS (SELECT hour_ts, list_sort(list(DISTINCT cell)) AS c FROM (SELECT hour_ts, cell, row_number() OVER (PARTITION BY hour_ts ORDER BY incident_count DESC, cell) AS n FROM p) WHERE n <= 20 GROUP BY hour_ts),
  l AS (SELECT hour_ts, c, lag(c) OVER (ORDER BY hour_ts) AS b FROM s) SELECT hour_ts, round(len(list_intersect(c, b)) / len(list_distinct(list_concat(c, b))), 6) AS jaccard FROM l WHERE b IS NOT NULL""")(
    lambda s, d: evaluate.stability(P(s, d).withColumn("yhat", F.col("incident_count"))))

query("asof_backward", "SELECT a.event_id, a.cell, a.ts, b.v AS last_value FROM (SELECT event_id, cell, ts FROM e WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT cell, ts, max(value) AS v FROM e WHERE event_type = 'view' GROUP BY ALL) b ON a.cell = b.cell AND a.ts >= b.ts")(
    lambda s, d: joins.asof(E(s, d).where("event_type = 'click'").select("event_id", "cell", "ts"), E(s, d).where("event_type = 'view'").select("cell", "ts", "value"), "ts", ["cell"], ["value"], prefix="last_"))
query("asof_forward", "SELECT a.event_id, a.cell, a.ts, b.v AS next_value FROM (SELECT event_id, cell, ts FROM e WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT cell, ts, max(value) AS v FROM e WHERE event_type = 'view' GROUP BY ALL) b ON a.cell = b.cell AND a.ts <= b.ts")(
    lambda s, d: joins.asof(E(s, d).where("event_type = 'click'").select("event_id", "cell", "ts"), E(s, d).where("event_type = 'view'").select("cell", "ts", "value"), "ts", ["cell"], ["value"], "forward", "next_"))
query("time_lag", "SELECT a.event_id, a.cell, a.ts, a.value, b.v AS value_lag_3h FROM e a ASOF LEFT JOIN (SELECT cell, ts + INTERVAL 3 HOUR AS ts, max(value) AS v FROM e GROUP BY ALL) b ON a.cell = b.cell AND a.ts >= b.ts")(
    lambda s, d: joins.time_lag(E(s, d).select("event_id", "cell", "ts", "value"), "ts", ["cell"], "value", 3))

HAV = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
SIZE, KLON = GRID.size_km, GRID.km_per_lon
HEX = f""", h0 AS (SELECT e.*, ((lon + 97.9) * {KLON!r} * {3**0.5 / 3!r} - (lat - 30.0) * 111.195 / 3) / {SIZE} AS q, (lat - 30.0) * 111.195 * {2 / 3!r} / {SIZE} AS r FROM e),
h1 AS (SELECT *, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(-q - r + 0.5) AS rs FROM h0),
h AS (SELECT * EXCLUDE (q, r, rq, rr, rs), CAST(CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs + q + r) THEN -rr - rs ELSE rq END AS BIGINT) AS hq,
  CAST(CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs + q + r) THEN rr WHEN abs(rr - r) > abs(rs + q + r) THEN -rq - rs ELSE rr END AS BIGINT) AS hr FROM h1)"""
DIST = "greatest(abs({a}.hq - {b}.hq), abs({a}.hr - {b}.hr), abs({a}.hq + {a}.hr - {b}.hq - {b}.hr))"
query("hex_cells", HEX + " SELECT event_id, (hq + 1048576) * 2097152 + hr + 1048576 AS hex, hq, hr FROM h")(
    lambda s, d: (lambda df: df.select("event_id", "hex", GRID.axial(F.col("hex"))[0].alias("hq"), GRID.axial(F.col("hex"))[1].alias("hr")))(E(s, d).select("event_id", GRID.cell(F.col("lat"), F.col("lon")).alias("hex"))))
query("haversine", f"SELECT a.event_id, round({HAV.format(a='a', b='b')}, 6) AS km FROM e a, (SELECT 30.05 AS lat, -97.85 AS lon) b")(
    lambda s, d: E(s, d).select("event_id", haversine_km(F.col("lat"), F.col("lon"), F.lit(30.05), F.lit(-97.85)).alias("km")))
query("neighbor_edges", HEX + f", c AS (SELECT DISTINCT hq, hr FROM h) SELECT (c.hq + 1048576) * 2097152 + c.hr + 1048576 AS cell, (c.hq + dq + 1048576) * 2097152 + c.hr + dr + 1048576 AS neighbor FROM c, (SELECT unnest(range(-1, 2)) AS dq), (SELECT unnest(range(-1, 2)) AS dr) WHERE abs(dq + dr) <= 1")(
    lambda s, d: joins.neighbor_edges(E(s, d).select(GRID.cell(F.col("lat"), F.col("lon")).alias("cell"))))
query("fuzzy_nearest_join", HEX + f""", m AS (SELECT a.event_id, b.event_id AS oid, b.value AS v, {HAV.format(a='a', b='b')} AS km, abs(epoch_us(a.ts) - epoch_us(b.ts)) / 3.6e9 AS dt, (b.hq + 1048576) * 2097152 + b.hr + 1048576 AS oc
  FROM h a JOIN h b ON a.event_type = 'click' AND b.event_type = 'view' AND {DIST.format(a='a', b='b')} <= 1),
 n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(km + 0.5 * 50 * dt, 9), oid) AS rn FROM m WHERE km <= 50 AND dt <= 1)
 SELECT e.event_id, round(v, 6) AS weather_value, round(km, 6) AS weather_distance_km, round(dt, 6) AS weather_time_diff_hours, round(round(km + 0.5 * 50 * dt, 9), 6) AS weather_combined_score, oc AS weather_cell FROM e LEFT JOIN n ON n.event_id = e.event_id AND rn = 1 WHERE e.event_type = 'click'""")(
    lambda s, d: joins.fuzzy_nearest(E(s, d).where("event_type = 'click'").select("event_id", "ts", "lat", "lon"), E(s, d).where("event_type = 'view'").select(F.col("event_id").alias("obs_id"), "ts", "lat", "lon", "value"), "event_id", ["value"]).drop("ts", "lat", "lon"))
query("radius_window_counts", f"""SELECT a.event_id, count(CASE WHEN b.ts >= a.ts - INTERVAL 1 HOUR THEN 1 END) AS nearby_count_1h, count(b.event_id) AS nearby_count_24h, round(avg(CASE WHEN b.ts >= a.ts - INTERVAL 1 HOUR THEN b.value END), 8) AS nearby_avg_value_1h, round(avg(b.value), 8) AS nearby_avg_value_24h
  FROM e a LEFT JOIN e b ON b.ts < a.ts AND b.ts >= a.ts - INTERVAL 24 HOUR AND a.event_id <> b.event_id AND {HAV.format(a='a', b='b')} <= 1.5 GROUP BY a.event_id""", 8)(
    lambda s, d: joins.radius_window(E(s, d).select("event_id", "ts", "lat", "lon", "value"), "event_id", means=("value",)).drop("ts", "lat", "lon", "value"))
HEXP = HEX + ", hp AS (SELECT hq, hr, hour_ts, avg(value) AS value FROM h GROUP BY ALL)"
query("neighbor_same_hour_agg", HEXP + f" SELECT (a.hq + 1048576) * 2097152 + a.hr + 1048576 AS cell, a.hour_ts, round(any_value(a.value), 6) AS value, round(avg(b.value), 6) AS spatial_mean_value_k1, round(max(b.value), 6) AS spatial_max_value_k1, round(sum(b.value), 6) AS spatial_sum_value_k1, round(any_value(a.value) - avg(b.value), 6) AS value_minus_neighbor_mean_k1 FROM hp a JOIN hp b ON a.hour_ts = b.hour_ts AND {DIST.format(a='a', b='b')} <= 1 GROUP BY a.hq, a.hr, a.hour_ts")(
    lambda s, d: joins.neighbor_aggregates(E(s, d).groupBy(GRID.cell(F.col("lat"), F.col("lon")).alias("cell"), temporal.floor_hour(F.col("ts")).alias("hour_ts")).agg(F.avg("value").alias("value")), ["value"]))

query("calendar_features", f"SELECT event_id, {CAL}, CAST(dayofyear(hour_ts) AS BIGINT) AS day_of_year, CAST(weekofyear(hour_ts) AS BIGINT) AS week_of_year, CAST(quarter(hour_ts) AS BIGINT) AS quarter, CAST(day(hour_ts) = 1 AS BIGINT) AS is_month_start, CAST(CAST(hour_ts AS DATE) = last_day(hour_ts) AS BIGINT) AS is_month_end, CAST(dayofyear(hour_ts) - 1 AS BIGINT) AS days_since_year_start FROM e")(
    lambda s, d: E(s, d).select("event_id", *[c.alias(n) for n, c in (temporal.calendar(F.col("ts")) | temporal.extended_calendar(F.col("ts"))).items()]))
query("time_bins", "SELECT event_id, CAST(CASE WHEN h <= 6 THEN 0 WHEN h <= 10 THEN 1 WHEN h <= 14 THEN 2 WHEN h <= 18 THEN 3 WHEN h <= 22 THEN 4 ELSE 5 END AS BIGINT) AS bucket, CAST(CASE WHEN h < 6 THEN 0 WHEN h < 10 THEN 1 WHEN h < 14 THEN 2 WHEN h < 18 THEN 3 WHEN h < 22 THEN 4 ELSE 5 END AS BIGINT) AS bucket_left, CAST(CASE WHEN h IN (7, 8) THEN 1 WHEN h IN (17, 18) THEN 2 ELSE 0 END AS BIGINT) AS rush_hour, CAST(isodow(ts) >= 6 AS BIGINT) AS day_period FROM (SELECT event_id, ts, hour(ts) AS h FROM e)")(
    lambda s, d: E(s, d).select("event_id", temporal.time_of_day_bucket(F.hour("ts")).alias("bucket"), temporal.time_of_day_bucket(F.hour("ts"), "left").alias("bucket_left"), temporal.rush_hour(F.hour("ts")).alias("rush_hour"), temporal.day_period(F.col("ts")).alias("day_period")))
TAU = "6.283185307179586"


def _holidays(s, e):
    """Flags by the holidays of the years that the events have, and New Year's Day behind them."""
    first, last = e.agg(F.min(F.year("ts")), F.max(F.year("ts"))).first()
    return temporal.holiday_flags(e, "ts", temporal.holidays(s, first or 2023, (last or 2023) + 1)).drop("ts")


query("cyclic_encoding", "SELECT event_id, " + ", ".join(f"round({f}({v} * ({TAU} / {n})), 6) + 0.0 AS {c}_{f}" for c, v, n in (("hour", "hour(ts)", 24), ("day_of_week", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12), ("hour_of_week", "((isodow(ts) - 1) * 24 + hour(ts))", 168)) for f in ("sin", "cos")) + ", round(sin(radians(value)), 6) AS wind_direction_sin, round(cos(radians(value)), 6) AS wind_direction_cos FROM e")(
    lambda s, d: E(s, d).select("event_id", *[(F.round(c, 6) + 0.0).alias(n) for n, c in (temporal.cyclic_calendar(F.col("ts")) | temporal.cyclic(temporal.hour_of_week(F.col("ts")), 168, "hour_of_week")).items()], *[c.alias(n) for n, c in temporal.wind_components(F.col("value")).items()]))
query("holiday_flags", "SELECT event_id, CAST(CAST(ts AS DATE) IN (DATE '2024-01-01', DATE '2024-01-15') AS BIGINT) AS is_holiday, CAST(CAST(ts AS DATE) IN (DATE '2023-12-31', DATE '2024-01-14') AS BIGINT) AS is_day_before_holiday, CAST(CAST(ts AS DATE) IN (DATE '2024-01-02', DATE '2024-01-16') AS BIGINT) AS is_day_after_holiday FROM e WHERE ts < TIMESTAMP '2024-02-15'")(
    lambda s, d: _holidays(s, E(s, d).select("event_id", "ts")))
query("one_hot_event_type", "SELECT event_id, " + ", ".join(f"CAST(event_type = '{v}' AS BIGINT) AS event_type_{v}" for v in ("error", "purchase", "signup", "view")) + " FROM e")(
    lambda s, d: encode.one_hot(E(s, d).select("event_id", "event_type"), "event_type", encode.categories(E(s, d), "event_type")))
query("precip_flags", "SELECT event_id, CAST(v > 0 AS BIGINT) AS precip_any, CAST(v >= (SELECT quantile_cont(coalesce(value, 0), 0.9) FROM e) AS BIGINT) AS precip_heavy_p90, CAST(pp >= 50 AS BIGINT) AS precip_prob_gt_50, CAST(pp >= 80 AS BIGINT) AS precip_prob_gt_80 FROM (SELECT event_id, coalesce(value, 0) AS v, coalesce(k, 0) AS pp FROM e)")(
    lambda s, d: (lambda e: e.select("event_id", *[c.alias(n) for n, c in encode.precipitation_flags(F.col("value"), encode.json_number(F.col("props"), "$.k"), F.lit(exact_quantiles(e.select(F.coalesce("value", F.lit(0.0)).alias("x")), "x", [0.9])[0])).items()]))(E(s, d)))
LIKE = lambda words: "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"
query("keyword_classify_documents", f"SELECT doc_id, CASE WHEN {LIKE(encode.KEYWORDS['CRASH'])} THEN 'CRASH' WHEN {LIKE(encode.KEYWORDS['HAZARDOUS CONDITION'])} THEN 'HAZARDOUS CONDITION' ELSE 'OTHER' END AS category, CASE WHEN {LIKE([w for v in encode.KEYWORDS.values() for w in v])} THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")(
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", encode.classify(F.col("text"))[0].alias("category"), encode.classify(F.col("text"))[1].alias("confidence")))
query("json_flatten_props", "SELECT event_id, CAST(k AS DOUBLE) AS k FROM e")(lambda s, d: E(s, d).select("event_id", encode.json_number(F.col("props"), "$.k").alias("k")))
query("flatten_location", "SELECT event_id, 'Point' AS location_type, round(lon, 6) AS location_lon, round(lat, 6) AS location_lat, round(lat, 6) AS lat, round(lon, 6) AS lon FROM e")(
    lambda s, d: clean.flatten_location(E(s, d).select("event_id", F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))).alias("location"))).drop("location"))
query("unit_conversions", "SELECT event_id, round(value * 1.8 + 32, 6) AS f, round(value - (100 - k) / 5.0, 6) AS dew FROM e")(
    lambda s, d: E(s, d).select("event_id", encode.fahrenheit(F.col("value")).alias("f"), encode.dew_point(F.col("value"), encode.json_number(F.col("props"), "$.k")).alias("dew")))

query("clean_filter_bbox", "SELECT event_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM e WHERE lat BETWEEN 30.015 AND 30.105 AND lon BETWEEN -97.885 AND -97.795")(
    lambda s, d: clean.bounding_box(E(s, d), (30.015, 30.105), (-97.885, -97.795)).select("event_id", "lat", "lon"))
query("majority_invalid_fallback", "SELECT event_id, CASE WHEN r < 0.5 THEN round(lat, 6) ELSE round(value, 6) END AS lat, CASE WHEN r < 0.5 THEN round(lon, 6) ELSE 0.0::DOUBLE END AS lon FROM e, (SELECT avg(CAST(value BETWEEN 25 AND 35 AS INT)) AS r FROM e)")(
    lambda s, d: clean.majority_fallback(E(s, d).select("event_id", F.col("value").alias("lat"), F.lit(0.0).alias("lon"), F.col("lat").alias("location_lat"), F.col("lon").alias("location_lon"))).select("event_id", "lat", "lon"))
query("clean_events", "SELECT CAST(event_id AS VARCHAR) AS incident_id, ts AS timestamp, event_type AS description, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value, 6) END AS lat, event_type AS status FROM e WHERE event_id % 5 <> 0")(
    lambda s, d: clean.clean_events(E(s, d).select(F.when(F.col("event_id") % 5 != 0, F.col("event_id").cast("string")).alias("traffic_report_id"), F.col("ts").cast("string").alias("published_date"), F.col("event_type").alias("issue_reported"), F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.col("value").cast("string")).alias("latitude"), F.col("event_type").alias("traffic_report_status"))).select("incident_id", "timestamp", "description", "lat", "status"))
query("dedupe_latest", "SELECT cell, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY ts DESC, event_id DESC) AS n FROM e) WHERE n = 1")(
    lambda s, d: clean.dedupe(E(s, d), ["cell"], F.desc("ts"), F.desc("event_id")).select("cell", "event_id", "ts"))
query("union_sources", "SELECT event_id, value, 'historical' AS data_source, NULL::BIGINT AS cell FROM e WHERE ts < TIMESTAMP '2024-01-10' UNION ALL SELECT event_id, value, 'forecast', cell FROM e WHERE ts >= TIMESTAMP '2024-01-10'")(
    lambda s, d: clean.union_all(E(s, d).where("ts < '2024-01-10'").select("event_id", "value", F.lit("historical").alias("data_source")), E(s, d).where("ts >= '2024-01-10'").select("event_id", "value", F.lit("forecast").alias("data_source"), "cell")))
query("semi_join_hours", "SELECT cell, hour_ts, incident_count FROM p WHERE hour_ts IN (SELECT hour_ts FROM e WHERE event_type = 'error' AND value > 300)")(
    lambda s, d: P(s, d).select("cell", "hour_ts", "incident_count").join(E(s, d).where("event_type = 'error' and value > 300").select(temporal.floor_hour(F.col("ts")).alias("hour_ts")), "hour_ts", "left_semi").select("cell", "hour_ts", "incident_count"))
query("anti_join_holdout", "SELECT cell, hour_ts, incident_count FROM p WHERE cell NOT IN (SELECT cell FROM e WHERE value > 480)")(
    lambda s, d: P(s, d).select("cell", "hour_ts", "incident_count").join(E(s, d).where("value > 480").select("cell").distinct(), "cell", "left_anti"))
query("real_over_synthetic", "SELECT p.cell, p.hour_ts, round(coalesce(v, p.value), 6) AS value, CASE WHEN r.cell IS NULL THEN 'synthetic' ELSE 'real' END AS provenance FROM p LEFT JOIN (SELECT cell, hour_ts, avg(value) AS v FROM e WHERE event_type = 'view' GROUP BY ALL) r USING (cell, hour_ts)")(
    lambda s, d: panel.fill_from(E(s, d).where("event_type = 'view'").groupBy("cell", temporal.floor_hour(F.col("ts")).alias("hour_ts")).agg(F.avg("value").alias("value")), P(s, d).select("cell", "hour_ts", "value"), ["cell", "hour_ts"], ["value"]))
query("nearest_hour_lookup", ", o AS (SELECT cell, hour_ts, median(value) AS value FROM e WHERE event_type = 'error' GROUP BY ALL), w AS (SELECT cell, hour_ts FROM p) SELECT cell, hour_ts, round(value, 6) AS value FROM (SELECT w.cell, w.hour_ts, o.value, row_number() OVER (PARTITION BY w.cell, w.hour_ts ORDER BY abs(epoch_us(o.hour_ts) - epoch_us(w.hour_ts)), o.hour_ts) AS n FROM w JOIN o USING (cell)) WHERE n = 1")(
    lambda s, d: joins.nearest_hour(E(s, d).where("event_type = 'error'").groupBy("cell", temporal.floor_hour(F.col("ts")).alias("hour_ts")).agg(F.median("value").alias("value")), P(s, d).select("cell", "hour_ts"), ["cell"]))

FOLDS = "f AS (SELECT f AS fold, m - INTERVAL 1 HOUR * ({step} * f) AS test_end, m - INTERVAL 1 HOUR * ({step} * f + {w}) AS test_start, m - INTERVAL 1 HOUR * ({step} * f + {w} + 1) AS train_end FROM (SELECT max(hour_ts) AS m FROM p), range(0, {n}) t(f))"
SIZES = "SELECT fold, CAST(count(*) FILTER (hour_ts < train_end) AS BIGINT) AS n_train, CAST(count(*) FILTER (hour_ts >= test_start AND hour_ts < test_end) AS BIGINT) AS n_test FROM p, f GROUP BY fold"
_sizes = lambda rows: rows.groupBy("fold").agg(F.count(F.when(F.col("role") == "train", 1)).alias("n_train"), F.count(F.when(F.col("role") == "test", 1)).alias("n_test"))
query("cv_fold_sizes", ", " + FOLDS.format(step=24, w=24, n=3) + SIZES)(lambda s, d: _sizes(splits.assign(P(s, d), splits.rolling_origin(P(s, d)))))
query("sliding_backtest_folds", ", " + FOLDS.format(step=1, w=3, n=8) + SIZES)(lambda s, d: _sizes(splits.assign(P(s, d), splits.sliding_backtest(P(s, d)))))
query("nested_cv_folds", ", " + FOLDS.format(step=24, w=24, n=3) + ", o AS (SELECT fold AS outer_fold, max(hour_ts) AS m FROM p, f WHERE hour_ts < train_end GROUP BY fold) SELECT outer_fold, i AS fold, m - INTERVAL 1 HOUR * (24 * i + 25) AS train_end, m - INTERVAL 1 HOUR * (24 * i + 24) AS test_start, m - INTERVAL 1 HOUR * (24 * i) AS test_end FROM o, range(0, 3) t(i)")(
    lambda s, d: splits.nested(P(s, d)))
query("cv_audit", ", " + FOLDS.format(step=24, w=24, n=3) + ", x AS (SELECT fold, count(*) FILTER (hour_ts < train_end) AS n_train, count(*) FILTER (hour_ts >= test_start AND hour_ts < test_end) AS n_test, max(hour_ts) FILTER (hour_ts < train_end) AS train_max, min(hour_ts) FILTER (hour_ts >= test_start AND hour_ts < test_end) AS test_min, max(hour_ts) FILTER (hour_ts >= test_start AND hour_ts < test_end) AS test_max FROM p, f GROUP BY fold) SELECT fold, n_train, n_test, train_max, test_min, train_max < test_min AS ordered, round((epoch_us(test_max) - epoch_us(test_min)) / 3.6e9, 6) AS span_hours FROM x")(
    lambda s, d: audit.audit_folds(splits.assign(P(s, d), splits.rolling_origin(P(s, d)))))

REG = "SELECT count(*) AS n, round(sqrt(avg((yhat - y) * (yhat - y))), 6) AS rmse, round(avg(abs(yhat - y)), 6) AS mae, CASE WHEN var_pop(y) > 0 THEN round(1 - avg((yhat - y) * (yhat - y)) / var_pop(y), 6) END AS r2, round(100 * avg(abs(yhat - y) / (abs(y) + abs(yhat) + 1e-8)), 6) AS smape, round(100 * avg(CASE WHEN y > 0 THEN abs(yhat - y) / y END), 6) AS mape FROM z WHERE y IS NOT NULL"
T = "t AS (SELECT *, lead(incident_count) OVER (PARTITION BY cell ORDER BY hour_ts) AS y FROM p)"
_target = lambda s, d: panel.lead_target(P(s, d)).withColumnRenamed("incident_count_t_plus_1", "y")
query("persistence_metrics", f", {T}, z AS (SELECT y, incident_count::DOUBLE AS yhat FROM t) " + REG)(lambda s, d: evaluate.regression(evaluate.predict_persistence(_target(s, d))))
CLIM = "a AS (SELECT * FROM t WHERE y IS NOT NULL AND hour_ts < TIMESTAMP '2024-01-20'), b AS (SELECT * FROM t WHERE hour_ts >= TIMESTAMP '2024-01-20'), m AS (SELECT cell, (isodow(hour_ts) - 1) * 24 + hour(hour_ts) AS how, avg(y) AS mean FROM a GROUP BY ALL), z AS (SELECT y, coalesce(mean, (SELECT avg(y) FROM a)) AS yhat FROM b LEFT JOIN m ON m.cell = b.cell AND m.how = (isodow(b.hour_ts) - 1) * 24 + hour(b.hour_ts)) "
query("climatology_metrics", f", {T}, {CLIM}" + REG)(
    lambda s, d: evaluate.regression(evaluate.predict_climatology(_target(s, d).where("hour_ts >= '2024-01-20'"), _target(s, d).where("y is not null and hour_ts < '2024-01-20'"), "y")))
HOT = """c AS (SELECT cell, hour(hour_ts) AS hod, avg(incident_count) AS yhat FROM p GROUP BY ALL), pr AS (SELECT p.cell, p.hour_ts, c.yhat FROM p JOIN c ON c.cell = p.cell AND c.hod = hour(p.hour_ts)),
 k AS (SELECT hour_ts, count(*) AS n, greatest(1, least({k}, greatest(5, count(*) // 10))) AS k_t FROM pr GROUP BY ALL),
 rp AS (SELECT hour_ts, cell, row_number() OVER (PARTITION BY hour_ts ORDER BY yhat DESC, cell) AS r FROM pr), ra AS (SELECT hour_ts, cell, row_number() OVER (PARTITION BY hour_ts ORDER BY incident_count DESC, cell) AS r FROM p)"""
PRK = HOT + """, o AS (SELECT k.hour_ts, count(*) AS overlap FROM k JOIN rp ON rp.hour_ts = k.hour_ts AND rp.r <= k_t JOIN ra ON ra.hour_ts = k.hour_ts AND ra.cell = rp.cell AND ra.r <= k_t GROUP BY ALL),
 m AS (SELECT hour_ts, count(*) AS n_actual, sum(incident_count) AS total FROM p GROUP BY ALL), x AS (SELECT coalesce(overlap, 0) / k_t AS pr, coalesce(overlap, 0) / least(k_t, n_actual) AS rc, total FROM k JOIN m USING (hour_ts) LEFT JOIN o USING (hour_ts) WHERE n >= k_t)
 SELECT count(*) AS hours, round(avg(pr), 6) AS precision_at_k, round(avg(rc), 6) AS recall_at_k, round(avg(CASE WHEN total > 0 THEN pr END), 6) AS conditional_precision, round(avg(CASE WHEN total > 0 THEN rc END), 6) AS conditional_recall FROM x"""
_clim = lambda s, d: (lambda p: p.join(p.groupBy("cell", F.hour("hour_ts").alias("hod")).agg(F.avg("incident_count").alias("yhat")).withColumnRenamed("cell", "_c"), (F.col("cell") == F.col("_c")) & (F.hour("hour_ts") == F.col("hod"))).select("cell", "hour_ts", "yhat"))(P(s, d))
_actual = lambda s, d: P(s, d).select("cell", "hour_ts", F.col("incident_count").alias("count"))
query("hotspot_precision_recall", ", " + PRK.format(k=50))(lambda s, d: evaluate.hotspots(_clim(s, d), _actual(s, d)))
query("historical_topk_baseline", ", " + PRK.format(k=20).replace("WHERE n >= k_t", "WHERE n >= k_t AND n >= 5"))(lambda s, d: evaluate.historical_top_k(P(s, d)))
query("hotspot_coverage", ", " + HOT.format(k=50) + """, i AS (SELECT k.hour_ts, rp.cell FROM k JOIN rp ON rp.hour_ts = k.hour_ts AND rp.r <= k_t), c2 AS (SELECT p.hour_ts, count(*) AS n_cells, count(i.cell) AS covered, sum(incident_count) AS a, sum(CASE WHEN i.cell IS NOT NULL THEN incident_count END) AS b FROM p LEFT JOIN i ON i.hour_ts = p.hour_ts AND i.cell = p.cell GROUP BY ALL)
 SELECT hour_ts, n_cells, covered, round(covered / n_cells, 6) AS coverage, round(coalesce(b, 0) / a, 6) AS weighted FROM c2""")(
    lambda s, d: evaluate.coverage(_clim(s, d), _actual(s, d)))
query("cell_hour_f1", ", pp AS (SELECT cell, hour_ts + INTERVAL 1 HOUR AS hour_ts, max(value / 500) >= 0.5 AS f FROM e GROUP BY cell, hour_ts), yy AS (SELECT cell, hour_ts, max(CAST(event_type = 'error' AS INT)) AS y FROM e GROUP BY ALL), c AS (SELECT count(*) FILTER (f AND y = 1) AS tp, count(*) FILTER (f AND y = 0) AS fp, count(*) FILTER (NOT f AND y = 1) AS fn, count(*) FILTER (NOT f AND y = 0) AS tn FROM pp JOIN yy USING (cell, hour_ts)) SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c")(
    lambda s, d: evaluate.cell_hour_f1(E(s, d).select("cell", "ts", (F.col("value") / 500).alias("p")), E(s, d).select("cell", "ts", (F.col("event_type") == "error").cast("int").alias("y"))))
_scored = lambda s, d: E(s, d).select((F.col("value") / 500).alias("p"), (F.col("event_type").isin("error", "purchase")).cast("int").alias("y"))
SC = ", sc AS (SELECT value / 500 AS p, CAST(event_type IN ('error', 'purchase') AS INT) AS y FROM e)"
query("ece", SC + ", b AS (SELECT greatest(ceil(p * 15), 1) AS b, count(*) AS n, avg(p) AS c, avg(y) AS a FROM sc GROUP BY 1) SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece, count(*) AS bins FROM b")(lambda s, d: evaluate.calibration_error(_scored(s, d)))
query("roc_pr_auc", SC + ", g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM sc GROUP BY p), w AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS al FROM g), x AS (SELECT p, tp / (SELECT sum(y) FROM sc) AS tpr, (al - tp) / (SELECT count(*) - sum(y) FROM sc) AS fpr, tp / al AS pc FROM w), l AS (SELECT *, lag(tpr, 1, 0) OVER o AS t0, lag(fpr, 1, 0) OVER o AS f0, lag(pc, 1, 1) OVER o AS p0 FROM x WINDOW o AS (ORDER BY p DESC)) SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS roc_auc, round(sum((tpr - t0) * (pc + p0) / 2), 6) AS pr_auc FROM l")(
    lambda s, d: evaluate.curves(_scored(s, d)))
query("weighted_class_metrics", ", c AS (SELECT event_type AS y, CASE WHEN value > 250 THEN 'view' ELSE event_type END AS h FROM e), s AS (SELECT y AS k, count(*) AS s, count(*) FILTER (y = h) AS tp FROM c GROUP BY y), m AS (SELECT h AS k, count(*) AS m FROM c GROUP BY h), x AS (SELECT sum(tp) / sum(s) AS acc, sum(s * coalesce(tp / m, 0)) / sum(s) AS pr FROM s LEFT JOIN m USING (k)) SELECT round(acc, 6) AS accuracy, round(pr, 6) AS precision, round(acc, 6) AS recall, round(0.6 * pr + 0.4 * acc, 6) AS weighted_f1 FROM x")(
    lambda s, d: evaluate.weighted(E(s, d).select(F.col("event_type").alias("y"), F.when(F.col("value") > 250, "view").otherwise(F.col("event_type")).alias("yhat"))))

query("lag_audit", "SELECT unnest(['value_lag_1h', 'value_lag_3h', 'value_rolling_mean_3h', 'value_rolling_max_3h', 'value_rolling_mean_6h', 'value_rolling_max_6h']) AS feature, (SELECT count(*) FROM p) AS checked, 0::BIGINT AS mismatches")(
    lambda s, d: audit.build_and_audit(P(s, d), "value"))
query("duplicate_rows", "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM e GROUP BY cell, event_type, k)")(
    lambda s, d: audit.duplicate_rows(E(s, d).select("cell", "event_type", encode.json_number(F.col("props"), "$.k").alias("k"))))
query("column_variance_topk", "SELECT unnest(['value', 'incident_count', 'cell']) AS feature, unnest([(SELECT round(var_samp(value), 6) FROM p), (SELECT round(var_samp(incident_count), 6) FROM p), (SELECT round(var_samp(cell), 6) FROM p)]) AS variance")(
    lambda s, d: audit.variances(P(s, d), ["value", "incident_count", "cell"]))
query("class_share", "SELECT event_type AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM e), 6) AS share FROM e GROUP BY ALL")(lambda s, d: audit.class_share(E(s, d), "event_type"))
query("quantiles", "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95 FROM e")(
    lambda s, d: s.createDataFrame([tuple(exact_quantiles(E(s, d), "value", [0.5, 0.9, 0.95]))], "p50 double, p90 double, p95 double"))
query("top_hotspots", "SELECT cell AS cell, CAST(sum(incident_count) AS BIGINT) AS predicted_incidents FROM p GROUP BY cell ORDER BY 2 DESC, cell LIMIT 10")(
    lambda s, d: serve.top_hotspots(P(s, d).groupBy("cell").agg(F.sum("incident_count").alias("predicted_incidents"))))
query("champion_rows", "SELECT channel, model, rmse FROM (VALUES ('base', 'linear', 2.0::DOUBLE), ('rich', 'linear', 1.0::DOUBLE)) t(channel, model, rmse)")(
    lambda s, d: evaluate.champion(s.createDataFrame([("base", "linear", 2.0), ("base", "persistence", 1.0), ("base", "random_forest", 2.0), ("rich", "random_forest", 3.0), ("rich", "linear", 1.0)], "channel string, model string, rmse double")))


def _features(s, d):
    p = panel.lead_target(P(s, d)).withColumnRenamed("incident_count_t_plus_1", "y").withColumns(temporal.calendar(F.col("hour_ts"))).withColumns(temporal.cyclic_calendar(F.col("hour_ts")))
    return windows.rolling_rows(windows.lags(p, ["value"], (1, 3)), ["value"], (3, 6)).fillna(0, ["value_lag_1h", "value_lag_3h"])


BASE = ["incident_count", "value", "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "is_weekend"]
RICH = [*BASE, "value_lag_1h", "value_lag_3h", "value_rolling_mean_3h", "value_rolling_max_3h", "value_rolling_mean_6h", "value_rolling_max_6h"]


def _sides(s, d):
    """Two kinds of events as the incidents, two as the observations."""
    e = E(s, d)
    obs = e.where("event_type in ('view', 'signup')").withColumns({"temperature": F.col("value"), "wind_direction": F.col("value"), "precipitation_amount": F.col("value"), "data_source": F.col("event_type")})
    return e.where("event_type in ('error', 'click')"), obs


def _round(df):
    """Circle components of 0 may be a tiny negative number, which rounds to -0.0."""
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in df.columns if c.endswith(("_sin", "_cos"))})


CIRCLE = lambda ts: ", ".join(f"round({f}({v} * ({TAU} / {n})), 6) + 0.0 AS {c}_{f}" for c, v, n in (("hour", f"hour({ts})", 24), ("day_of_week", f"(isodow({ts}) - 1)", 7), ("month", f"month({ts})", 12)) for f in ("sin", "cos"))
WIND = lambda c: f"round(sin(radians({c})), 6) + 0.0 AS wind_direction_sin, round(cos(radians({c})), 6) + 0.0 AS wind_direction_cos"
query("base_features", f""", a AS (SELECT cell, hour_ts, count(DISTINCT event_type) AS u FROM e WHERE event_type IN ('error', 'click') GROUP BY ALL),
 b AS (SELECT cell, hour_ts, median(value) AS t, max(value) AS r, min_by(event_type, (ts, event_id)) AS s FROM e WHERE event_type IN ('view', 'signup') GROUP BY ALL),
 j AS (SELECT * FROM a FULL JOIN b USING (cell, hour_ts)), c AS (SELECT hour_ts, median(t) AS mt, median(r) AS mr FROM j GROUP BY ALL),
 m AS (SELECT hour_ts, s AS ms FROM (SELECT hour_ts, s, row_number() OVER (PARTITION BY hour_ts ORDER BY count(*) DESC, s) AS n FROM j WHERE s IS NOT NULL GROUP BY hour_ts, s) WHERE n = 1),
 k AS (SELECT cell, hour_ts, u, coalesce(t, mt) AS t, coalesce(r, mr) AS r, coalesce(s, ms) AS s FROM j JOIN c USING (hour_ts) LEFT JOIN m USING (hour_ts))
 SELECT cell, hour_ts, {CAL}, u AS n_unique_agency, u AS n_unique_status, round(t, 6) AS weather_temperature, round(r, 6) AS weather_precipitation_amount, {WIND("t")}, {CIRCLE("hour_ts")},
  CAST(coalesce(s = 'view', false) AS BIGINT) AS weather_data_source_view, CAST(t IS NOT NULL AS BIGINT) AS has_weather_data FROM k""")(
    lambda s, d: _round(features.model_features(features.base_panel(*_sides(s, d), tie="event_id"))))
query("target_table", "SELECT cell, hour_ts, incident_count AS incident_count_t, lead(incident_count) OVER (PARTITION BY cell ORDER BY hour_ts) AS incident_count_t_plus_1 FROM p")(
    lambda s, d: features.targets(P(s, d)))
query("rich_features", "SELECT cell, hour_ts, incident_count, round(value, 8) AS value, CAST(CASE WHEN hour(hour_ts) <= 6 THEN 0 WHEN hour(hour_ts) <= 10 THEN 1 WHEN hour(hour_ts) <= 14 THEN 2 WHEN hour(hour_ts) <= 18 THEN 3 WHEN hour(hour_ts) <= 22 THEN 4 ELSE 5 END AS BIGINT) AS time_of_day_bucket, CAST(CASE WHEN hour(hour_ts) IN (7, 8) THEN 1 WHEN hour(hour_ts) IN (17, 18) THEN 2 ELSE 0 END AS BIGINT) AS rush_hour, CAST(isodow(hour_ts) >= 6 AS BIGINT) AS day_period, CAST(dayofyear(hour_ts) AS BIGINT) AS day_of_year, CAST(weekofyear(hour_ts) AS BIGINT) AS week_of_year, CAST(quarter(hour_ts) AS BIGINT) AS quarter, CAST(day(hour_ts) = 1 AS BIGINT) AS is_month_start, CAST(CAST(hour_ts AS DATE) = last_day(hour_ts) AS BIGINT) AS is_month_end, CAST(dayofyear(hour_ts) - 1 AS BIGINT) AS days_since_year_start, "
    + ", ".join([f"round(lag(value, {k}) OVER ({W}), 8) AS value_lag_{k}h" for k in windows.LAGS] + [f"round({ROLL[n]}(value) OVER ({W} ROWS {w - 1} PRECEDING), 8) AS value_rolling_{n}_{w}h" for w in windows.WIDTHS for n in ("mean", "max")]) + " FROM p", 8)(
    lambda s, d: features.rich_features(P(s, d), ["value"]))
query("event_features", f"SELECT event_id, ts AS timestamp, {CAL.replace('hour_ts', 'ts')}, {CIRCLE('ts')}, {WIND('value')}, CAST(value IS NOT NULL AS BIGINT) AS has_weather_data, " + ", ".join(f"CAST(event_type = '{v}' AS BIGINT) AS weather_data_source_{v}" for v in ("error", "purchase", "signup", "view")) + " FROM e")(
    lambda s, d: _round(features.event_features(E(s, d).select("event_id", "incident_id", F.col("ts").alias("timestamp"), F.col("value").alias("weather_wind_direction"), F.col("event_type").alias("weather_data_source"), F.col("lat").alias("location_lat")))))
query("category_distribution", f"SELECT incident_category AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM (SELECT CASE WHEN {LIKE(encode.KEYWORDS['CRASH'])} THEN 'CRASH' WHEN {LIKE(encode.KEYWORDS['HAZARDOUS CONDITION'])} THEN 'HAZARDOUS CONDITION' ELSE 'OTHER' END AS incident_category FROM (SELECT lower(coalesce(text, '')) AS t FROM documents)) GROUP BY ALL")(
    lambda s, d: audit.class_share(features.category_target(s.read.parquet(f"{d}/documents.parquet"), "text", "doc_id"), "incident_category"))


@query("robustness_checks")
def _robustness(s, d):
    return train.robustness(_features(s, d), "linear", BASE)


@query("permutation_test")
def _permutation(s, d):
    more = _features(s, d).withColumn("y", F.col("y") - 1)  # hours of the test tables have a count of 1 at least
    return train.permutation_test(more, BASE)


@query("ml_competition")
def _compete(s, d):
    return train.compete(_features(s, d), {"base": BASE, "rich": RICH}, trials=2, inner=2, spaces=train.QUICK).drop("train_s")


@query("batch_score_next_hours")
def _serve(s, d):
    f = _features(s, d)
    model = train.pipeline("linear", BASE, "y").fit(f.where("y is not null"))
    last = f.agg(F.max("hour_ts")).first()[0]
    rows = serve.serving_features(serve.serving_grid(f, str(last), 3), P(s, d).select("cell", "hour_ts", "value", "incident_count"), BASE)
    return serve.score(model, rows).drop("prediction_timestamp")
