"""Layers as a whole, orders without one partition, and the model suites, on small tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sectorflow.functions.geo import HexGrid
from sectorflow.operators import audit, evaluate, joins, ordered, train
from sectorflow.plans import catalog, features

T = dt.datetime(2024, 1, 1)
H = dt.timedelta(hours=1)


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def panel(spark):
    data = [(c, T + i * H, (i * c) % 4, float((i * 7 + c) % 11)) for c in range(1, 13) for i in range(120)]
    return rows(spark, data, "cell long, hour_ts timestamp_ntz, incident_count long, value double").cache()


def with_target(df):
    return features.targets(df).withColumnRenamed("incident_count_t_plus_1", "y").select("cell", "hour_ts", "y").join(df, ["cell", "hour_ts"])


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_against_brute_force(spark, direction):
    import random

    rng = random.Random(5)
    left = [(i, rng.choice([1, 2, None]), None if i == 3 else T + rng.randrange(900) * H / 6) for i in range(150)]
    right = [(rng.choice([1, None, 3]), None if i == 7 else T + rng.randrange(900) * H / 6, float(i)) for i in range(60)]
    got = joins.asof(rows(spark, left, "id int, k int, ts timestamp_ntz"), rows(spark, right, "k int, ts timestamp_ntz, v double"), "ts", ["k"], ["v"], direction, "o_").collect()
    for r in got:
        same = [(t, v) for k, t, v in right if k == r.k and t is not None and r.ts is not None and (t <= r.ts if direction == "backward" else t >= r.ts)]
        at = (max if direction == "backward" else min)((t for t, _ in same), default=None)
        assert r.o_v == max((v for t, v in same if t == at), default=None)
    assert len(got) == 150


def test_asof_without_rows(spark):
    left, right = rows(spark, [(1, T)], "k int, ts timestamp_ntz"), rows(spark, [], "k int, ts timestamp_ntz, v double")
    assert [tuple(r) for r in joins.asof(left, right, "ts", ["k"], ["v"]).collect()] == [(1, T, None)]
    assert joins.asof(left.limit(0), right, "ts", ["k"], ["v"]).count() == 0


def test_nearest_hour_takes_the_earlier_of_equals(spark):
    obs = rows(spark, [(1, T, 1.0), (1, T + 2 * H, 3.0), (1, T + 9 * H, 9.0)], "cell long, hour_ts timestamp_ntz, v double")
    want = rows(spark, [(1, T + i * H) for i in (0, 1, 2, 8)] + [(2, T)], "cell long, hour_ts timestamp_ntz")
    assert sorted((r.hour_ts, r.v) for r in joins.nearest_hour(obs, want, ["cell"]).collect()) == [(T, 1.0), (T + H, 1.0), (T + 2 * H, 3.0), (T + 8 * H, 9.0)]


def test_numbers_and_running_sums(spark):
    df = spark.range(3000).withColumn("k", F.col("id") % 1500)
    n = [r[0] for r in ordered.number_by_hash(df, ["k"], 3).select("_n").collect()]
    assert sorted(n) == list(range(1, 3001))
    one = rows(spark, [(float(x), 1) for x in (5, 1, 3, -2)], "s double, n int")
    assert sorted((r.s, r.n_upto) for r in ordered.cumulative(one, "s", ["n"]).collect()) == [(-2.0, 1), (1.0, 2), (3.0, 3), (5.0, 4)]
    assert [r.n_upto for r in ordered.cumulative(one.limit(1), "s", ["n"]).collect()] == [1]


def test_curves_with_ties(spark):
    m = evaluate.curves(rows(spark, [(0.9, 1), (0.9, 0), (0.4, 1), (0.1, 0)], "p double, y int")).first()
    assert abs(m["roc_auc"] - 0.625) < 1e-12
    assert abs(m["pr_auc"] - (0.5 * (0.5 + 1) / 2 + 0.5 * (2 / 3 + 0.5) / 2)) < 1e-12


def test_permute_keeps_the_values(spark, panel):
    out = audit.permute(panel, "value", ["cell", "hour_ts"])
    assert out.count() == panel.count()
    both = out.groupBy("value").count().join(out.groupBy(F.col("value_permuted").alias("value")).agg(F.count("*").alias("m")), "value")
    assert both.where("count <> m").count() == 0 and both.count() == 11
    assert out.where("value <> value_permuted").count() > panel.count() / 2


def test_bronze_to_silver(spark, tmp_path):
    raw = rows(spark, [("1", "2024-01-01 05:00:00", "30.5", "-97.5"), ("2", "bad", "30.5", "-97.5"), (None, "2024-01-01 05:00:00", "1", "1")], "traffic_report_id string, published_date string, latitude string, longitude string")
    raw.write.parquet(str(tmp_path / "bronze"))
    meta = features.bronze_to_silver(spark, str(tmp_path / "bronze"), str(tmp_path / "silver"))
    assert meta["row_count"] == 1 and json.loads((tmp_path / "silver_metadata.json").read_text())["row_count"] == 1
    assert spark.read.parquet(str(tmp_path / "silver")).first()["lat"] == 30.5


def test_base_panel_fills_from_the_city(spark):
    at = "incident_id string, timestamp timestamp_ntz, lat double, lon double, agency string, status string"
    ev = features.with_cells(rows(spark, [("a", T, 30.0, -97.9, "x", "s"), ("b", T, 30.4, -97.5, "x", "s"), ("c", T, 0.0, -97.9, "x", "s")], at))
    ob = features.with_cells(rows(spark, [(T, 30.0, -97.9, 20.0, 90.0, 61.0), (T, 30.2, -97.7, 30.0, 180.0, 0.0)], "timestamp timestamp_ntz, lat double, lon double, temperature double, wind_direction double, weather_code double"))
    x = features.model_features(features.base_panel(ev, ob))
    assert x.count() == 3 and "incident_count" not in x.columns and "weather_wind_direction" not in x.columns
    filled = {r.cell: r for r in x.collect()}[features.with_cells(ev.where("incident_id = 'b'")).first()["cell"]]
    assert filled["weather_temperature"] == 25.0 and filled["has_weather_data"] == 1 and filled["weather_weather_code_61.0"] == 0


def test_rich_extras(spark, panel):
    df = panel.withColumns({"weather_precipitation_amount": F.col("value"), "cell": HexGrid().pack(F.col("cell"), F.lit(0))})
    out = features.rich_features(df, ["value"], extras=True, days=spark.sql("select date'2024-01-01' as date"), grid=HexGrid())
    assert out.count() == df.count()
    for c in ("value_rolling_cv_6h", "value_rolling_slope_6h", "hour_of_week_sin", "precip_heavy_p90", "spatial_mean_value_k1", "is_holiday", "value_lag_24h"):
        assert c in out.columns
    assert out.where("hour_ts < '2024-01-02' and is_holiday = 0").count() == 0


def test_category_target(spark):
    df = rows(spark, [("1", "Crash Urgent"), ("2", None)], "incident_id string, description string")
    assert [(r.incident_category, r.incident_category_confidence) for r in features.category_target(df).orderBy("incident_id").collect()] == [("CRASH", 1.0), ("OTHER", 0.9)]


def test_suites(spark, panel):
    df = with_target(panel)
    r = {x.experiment: x for x in train.robustness(df, "linear", ["incident_count", "value"], steps=(1, 3)).collect()}
    assert set(r) == {"without_count", "horizon_1", "horizon_3", "cold_start"} and r["without_count"]["n_features"] == 1
    # the next count is (i + 1) * cell modulo 4: the leaked feature tells it, labels dealt anew do not
    p = train.permutation_test(df.withColumn("leak", F.col("y")), ["leak"], repeats=1).orderBy("run").collect()
    assert p[0]["f1"] > 0.99 and p[1]["f1"] < 0.99
    s = train.leakage_suite(df.withColumn("target_leak", F.coalesce("y", F.lit(0))), ["target_leak", "value"]).collect()
    flagged = {(x.check, x.subject) for x in s if x.suspicious}
    assert ("name", "target_leak") in flagged and ("single_feature", "target_leak") in flagged
    assert {x.check for x in s} == {"name", "single_feature", "permutation", "fold", "duplicates"} and not any(x.suspicious for x in s if x.check in ("fold", "duplicates"))


def test_holiday_query_takes_all_years(spark, tmp_path):
    days = ["2024-01-01", "2024-02-20", "2024-12-25", "2025-07-03", "2025-12-31"]
    e = spark.createDataFrame(list(enumerate(days)), "event_id long, day string").selectExpr("event_id", "cast(day as timestamp) as ts", "1L as user_id", "'view' as event_type", "1.0D as value", "'{}' as props")
    e.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: (r.is_holiday, r.is_day_before_holiday, r.is_day_after_holiday) for r in catalog.queries()["holiday_flags"](spark, str(tmp_path)).collect()}
    assert got == {0: (1, 0, 0), 1: (0, 0, 1), 2: (1, 0, 0), 3: (0, 1, 0), 4: (0, 1, 0)}


def test_competition_searches_inner_folds(spark, panel):
    got = train.compete(with_target(panel), {"base": ["incident_count", "value"]}, models=("linear",), folds=1, trials=2, inner=2).collect()
    assert {r.model for r in got} == {"persistence", "climatology", "linear"}


def test_exact_quantiles_in_passes(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    x = [float(v) for v in np.r_[rng.lognormal(0, 9, 3000), [5.0] * 2000, -1e300, 1e300]]
    df = rows(spark, [(v,) for v in [*x, None, float("nan")]], "x double")
    shares = [0.0, 0.1, 0.5, 0.77, 0.9, 1.0]
    for few in (100_000, 10):
        assert np.allclose(ordered.exact_quantiles(df, "x", shares, bins=16, few=few), np.quantile(x, shares), rtol=1e-12)
    assert ordered.exact_quantiles(df.limit(0), "x", [0.5]) == [None]


def test_rolling_time_over_buckets(spark):
    """The same with and without buckets of time, and with one busy key."""
    from sectorflow.operators import windows

    data = [(k % 3 if k % 2 else 0, T + (k * 37 % 4000) * H / 40, float(k % 17)) for k in range(800)] + [(0, None, 1.0)]
    df = rows(spark, data, "cell int, ts timestamp_ntz, x double")
    key = lambda out: sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in out.collect())
    for by in (["cell"], []):
        assert key(windows.rolling_time(df, "x", 3, "ts", by)) == key(windows.rolling_time(df, "x", 3, "ts", by, bucket_hours=100_000))


def test_radius_near_a_pole_and_across_bands(spark):
    import math
    import random

    r = random.Random(8)
    ev = [(i, T + r.randrange(3000) * H / 60, r.choice([30.0, 60.0, 89.95]) + r.random() * 0.05 * r.choice([-1, 1]), -97.9 + r.random() * 0.06) for i in range(160)] + [(999, T, 90.0, 10.0)]
    df = rows(spark, ev, "id int, ts timestamp_ntz, lat double, lon double")
    got = {x.id: (x.nearby_count_1h, x.nearby_count_24h) for x in joins.radius_window(df, "id", 1.5).collect()}

    def km(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1, h)))

    for a in ev:
        near = [b for b in ev if b[0] != a[0] and b[1] < a[1] and km(a, b) <= 1.5]
        assert got[a[0]] == tuple(sum(b[1] >= a[1] - w * H for b in near) for w in (1, 24))


def test_curves_of_skewed_scores(spark):
    data = [(1e-9 * i, i % 7 == 0) for i in range(400)] + [(0.9, True), (1.0, False)]
    m = evaluate.curves(rows(spark, [(p, int(y)) for p, y in data], "p double, y int")).first()
    pos, neg = [p for p, y in data if y], [p for p, y in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(m["roc_auc"] - want) < 1e-9


def test_count_trees_learn_rates(spark, panel):
    df = panel.withColumn("y", F.when(F.col("cell") > 6, 9).otherwise(1))
    model = train.pipeline("boosted_trees", ["cell", "value"], objective="poisson", maxIter=25, maxDepth=2, stepSize=0.3, subsamplingRate=0.8, featureSubsetStrategy="all").fit(df)
    got = train.predict(model, df).groupBy("y").agg(F.avg("yhat").alias("m")).collect()
    assert all(abs(r.m - r.y) < 0.15 for r in got) and train.top_features(model, ["cell", "value"])[0][0] == "cell"
    assert not {c for c in train.predict(model, df).columns if c.startswith("_t")}


def test_paging_stops_early_and_caches_survive(spark, tmp_path):
    from sectorflow.sources import made_up, readers

    asked = []

    def get(url):
        asked.append(url)
        return made_up.records(url)

    got = readers.fetch_recent(spark, "mem://x", "incident_id string, published_date timestamp_ntz", "2024-04-10T00:00:00", "2024-12-31T00:00:00", page=50, get=get)
    assert got.count() > 0 and len(asked) < 10
    calls = []
    for t in (0.0, 5.0, 50.0):
        cache = readers.TtlCache(lambda k: calls.append(k) or [k, 1], readers.FileStore(str(tmp_path / "c")), 10, lambda t=t: t)
        assert cache.get("a") == ["a", 1]
    assert calls == ["a", "a"]


def test_models_by_channel(spark, panel, tmp_path):
    from sectorflow.sources import sinks

    df = with_target(panel).where("y is not null")
    sinks.save_model(train.pipeline("linear", ["value"]).fit(df), str(tmp_path / "m"), {"rmse": 1.0}, "base")
    sinks.save_model(train.pipeline("linear", ["incident_count"]).fit(df), str(tmp_path / "m"), {"rmse": 2.0}, "rich")
    assert sinks.load_model(str(tmp_path / "m"), "base")[1] == {"rmse": 1.0}
    with pytest.raises(ValueError, match="base"):
        sinks.load_model(str(tmp_path / "m"), "other")
