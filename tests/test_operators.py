import datetime as dt

from pyspark.sql import functions as F

from sectorflow.functions import encode, temporal
from sectorflow.functions.geo import HexGrid
from sectorflow.operators import clean, evaluate, joins, panel, splits, windows
from sectorflow.sources import readers, sinks, synthetic
from sectorflow.streaming import rollup

T = dt.datetime(2024, 1, 1)
H = dt.timedelta(hours=1)


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_time_lag_never_looks_ahead(spark):
    df = rows(spark, [("a", T + i * H, float(i)) for i in range(6)], "cell string, ts timestamp_ntz, x double")
    got = [r[0] for r in joins.time_lag(df, "ts", ["cell"], "x", 2).orderBy("ts").select("x_lag_2h").collect()]
    assert got == [None, None, 0, 1, 2, 3]


def test_rolling_time_is_left_open_with_peers(spark):
    df = rows(spark, [(1, T, 1.0), (1, T + H, 2.0), (1, T + 3 * H, 4.0), (1, T + 3 * H, 8.0), (1, T + 4 * H, 16.0)], "cell int, ts timestamp_ntz, x double")
    r = windows.rolling_time(df, "x", 3, "ts", ["cell"], ("mean", "std")).orderBy("ts", "x").collect()
    assert [round(a["x_rolling_mean_3h"], 4) for a in r] == [1.0, 1.5, round(14 / 3, 4), round(14 / 3, 4), round(28 / 3, 4)]
    assert r[0]["x_rolling_std_3h"] is None


def test_trend_and_partial_last(spark):
    df = rows(spark, [(1, T + i * H, y) for i, y in enumerate([1.0, 2.0, 4.0])], "cell long, hour_ts timestamp_ntz, y double")
    r = windows.trend(df, ["y"], (3, 6), partial_last=True).orderBy("hour_ts").collect()
    assert r[0]["y_rolling_slope_3h"] is None
    assert abs(r[2]["y_rolling_slope_3h"] - 1.5) < 1e-5
    assert abs(r[2]["y_rolling_slope_6h"] - 1.5) < 1e-5


def test_bins_one_hot_classes(spark):
    h = spark.range(24).select(temporal.time_of_day_bucket(F.col("id")).alias("b")).toPandas().b.value_counts().to_dict()
    assert h == {0: 7, 1: 4, 2: 4, 3: 4, 4: 4, 5: 1}
    df = rows(spark, [(3.0,), (0.0,), (None,), (61.0,)], "code double")
    hot = encode.one_hot(df, "code", encode.categories(df, "code"))
    assert hot.columns == ["code_3.0", "code_61.0"]
    assert [tuple(r) for r in hot.collect()] == [(1, 0), (0, 0), (0, 0), (0, 1)]
    text = rows(spark, [("Crash Urgent",), ("Stopped truck",), ("TRFC HAZD/ DEBRIS",), ("Stalled Vehicle",), ("xyz",), (None,)], "d string")
    got = [tuple(r) for r in text.select(*encode.classify(F.col("d"))).collect()]
    assert got == [("CRASH", 1.0), ("CRASH", 1.0), ("HAZARDOUS CONDITION", 1.0), ("OTHER", 1.0), ("OTHER", 0.9), ("OTHER", 0.9)]


def test_hex_round_trip_and_neighbors(spark):
    g = HexGrid()
    df = spark.range(400).select((30 + F.col("id") % 20 * 0.013).alias("lat"), (-98 + F.floor(F.col("id") / 20) * 0.017).alias("lon")).withColumn("cell", g.cell(F.col("lat"), F.col("lon")))
    lat, lon = g.centroid(F.col("cell"))
    again = df.withColumn("c2", g.cell(lat, lon)).where("cell <> c2").count()
    assert again == 0
    assert df.select(F.size(g.neighbors(F.col("cell"), 2)).alias("n")).distinct().collect()[0]["n"] == 19
    assert df.select(F.size(g.neighbors(F.col("cell"), 2, ring_only=True, with_self=False)).alias("n")).distinct().collect()[0]["n"] == 12
    assert df.select(g.from_hex(g.to_hex(F.col("cell"))).alias("x"), "cell").where("x <> cell").count() == 0


def test_smape_dynamic_k_folds(spark):
    m = evaluate.regression(rows(spark, [(0.0, 0.0), (2.0, 1.0)], "y double, yhat double")).first()
    assert abs(m["smape"] - 100 / 6) < 1e-3
    assert [r[0] for r in rows(spark, [(8,), (60,), (900,)], "n int").select(evaluate.dynamic_k(F.col("n"), 50)).collect()] == [5, 6, 50]
    df = rows(spark, [(T + i * H,) for i in range(96)], "hour_ts timestamp_ntz")
    f = [(r.fold, (r.test_start - T) / H, (r.test_end - T) / H, (r.train_end - T) / H) for r in splits.rolling_origin(df).orderBy("fold").collect()]
    assert f == [(0, 71, 95, 70), (1, 47, 71, 46), (2, 23, 47, 22)]


def test_order_and_future_do_not_matter(spark):
    df = rows(spark, [(c, T + i * H, float((i * 7 + c) % 5)) for c in (1, 2) for i in range(0, 30, 2)], "cell long, hour_ts timestamp_ntz, value double")
    f = lambda d: windows.rolling_rows(windows.lags(d, ["value"], (1, 3)), ["value"], (3,)).orderBy("cell", "hour_ts").toPandas()
    full, early = f(df.orderBy(F.rand(3))), f(df.where(F.col("hour_ts") < T + 15 * H))
    cut = full[full.hour_ts < T + 15 * H].reset_index(drop=True)
    assert cut.equals(early)


def test_clean_flatten_and_metadata(spark, tmp_path):
    df = spark.createDataFrame([("1", None, '{"type":"Point","coordinates":[-97.5,30.5]}', "2024-01-01 05:00:00"), (None, "2", None, "bad")], "traffic_report_id string, incident_number string, location string, published_date string")
    out = clean.clean_events(df).collect()
    assert len(out) == 1 and out[0]["lat"] == 30.5 and out[0]["lon"] == -97.5
    ok = clean.clean_events(df)
    sinks.write_by_date(ok, str(tmp_path / "b"))
    assert readers.read_days(spark, str(tmp_path / "b"), "2024-01-01", "2024-01-01").count() == 1
    assert sinks.metadata(ok)["row_count"] == 1


def test_payload_and_fetch(spark):
    df = spark.createDataFrame([(1.0, 2.0, (["2024-01-01T00:00", "2024-01-01T01:00"], ["3.5"]))], "lat double, lon double, hourly struct<time: array<string>, temperature: array<string>>")
    assert [r["temperature"] for r in readers.observations_from_payload(df, ["temperature"], "historical").orderBy("timestamp").collect()] == [3.5, None]
    pages = {"u1": '[{"a": 1}, {"a": 2}]', "u2": "[]"}
    assert sorted(r["a"] for r in readers.fetch_records(spark, list(pages), "a int", lambda u: pages[u]).collect()) == [1, 2]
    now = [0.0]
    cache = readers.TtlCache(lambda k: (k, now[0]), seconds=10, clock=lambda: now[0])
    a = cache.get("x")
    now[0] = 5
    assert cache.get("x") == a
    now[0] = 20
    assert cache.get("x") != a


def test_synthetic_and_stream(spark, tmp_path):
    p = synthetic.panel(spark, synthetic.Config(days=2, cells=7))
    assert p.count() == 7 * 48 and p.select("cell").distinct().count() == 7
    ev = rows(spark, [(T + i * H / 4, 1) for i in range(16)], "ts timestamp_ntz, cell int")
    ev.write.parquet(str(tmp_path / "in"))
    rollup.run_available(spark, str(tmp_path / "in"), ev.schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.agg(F.sum("incident_count")).first()[0] == 4  # hours before the watermark are closed
    assert rollup.hourly_counts(ev).count() == 4


def test_impute_and_strict_target(spark):
    df = rows(spark, [(1, T, 1.0, 2), (2, T, None, 1), (3, T, 3.0, 1), (1, T + 2 * H, 5.0, 4)], "cell long, hour_ts timestamp_ntz, v double, incident_count long")
    assert {r.cell: r.v for r in panel.impute_by_hour(df, ["v"]).where(F.col("hour_ts") == T).collect()}[2] == 2.0
    assert panel.lead_target(df).where("cell = 1").orderBy("hour_ts").first()["incident_count_t_plus_1"] == 4
    assert panel.lead_target(df, mode="hour").where("cell = 1").orderBy("hour_ts").first()["incident_count_t_plus_1"] is None
