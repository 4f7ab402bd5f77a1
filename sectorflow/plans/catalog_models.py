"""Queries of models, their tables, suites and serving, on features for which SQL has the fitted model in closed form.

Least squares in one or two features are sums; a Poisson regression, a tree, a forest of one tree and boosted trees on one
0/1 feature predict the means of its two groups, and Poisson boosting moves towards them by known steps.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import serve, train
from ..sources import sinks
from ..sources.folders import work_folder
from .catalog import FOLDS, REG, P, T, _target, query
from .catalog_sources import DIGEST

#: The panel with the next count as y, and a 0/1 feature.
Y = f", {T}, r AS (SELECT cell, hour_ts, incident_count::DOUBLE AS x1, value AS x2, CAST(value > 250 AS INT) AS big, y FROM t)"
_rows = lambda s, d: _target(s, d).withColumn("big", (F.col("value") > 250).cast("int"))
_known = lambda df: df.where("y is not null")
_out = lambda model, df: train.predict(model, df).select("cell", "hour_ts", "yhat")
TWO = """, m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM r WHERE y IS NOT NULL),
 w AS (SELECT *, (c1 * v2 - c2 * c) / (v1 * v2 - c * c) AS a, (c2 * v1 - c1 * c) / (v1 * v2 - c * c) AS b FROM m)"""
query("linear_regression", Y + TWO + " SELECT cell, hour_ts, round(greatest(my + a * (x1 - m1) + b * (x2 - m2), 0), 6) AS yhat FROM r, w")(
    lambda s, d: _out(train.pipeline("linear", ["incident_count", "value"]).fit(_known(_rows(s, d))), _rows(s, d)))
query("top_features", Y + TWO + " SELECT f AS feature, round(x, 6) AS weight FROM (SELECT unnest(['incident_count', 'value']) AS f, unnest([abs(a) * sqrt(v1 * n / (n - 1)), abs(b) * sqrt(v2 * n / (n - 1))]) AS x FROM w, (SELECT count(*) AS n FROM r WHERE y IS NOT NULL))")(
    lambda s, d: s.createDataFrame(train.top_features(train.pipeline("linear", ["incident_count", "value"]).fit(_known(_rows(s, d))), ["incident_count", "value"]), "feature string, weight double"))
MEANS = Y + ", g AS (SELECT big, avg(y) AS yhat FROM r WHERE y IS NOT NULL GROUP BY big) SELECT cell, hour_ts, round(yhat, 6) AS yhat FROM r JOIN g USING (big)"
query("poisson_regression", MEANS.replace("round(yhat, 6)", "round(yhat, 5)"), 5)(lambda s, d: _out(train.pipeline("poisson", ["big"], tol=1e-12, maxIter=100).fit(_known(_rows(s, d))), _rows(s, d)))
query("forest_of_one_tree", MEANS)(lambda s, d: _out(train.pipeline("random_forest", ["big"], numTrees=1, maxDepth=2, bootstrap=False).fit(_known(_rows(s, d))), _rows(s, d)))
query("boosted_trees", MEANS)(lambda s, d: _out(train.pipeline("boosted_trees", ["big"], maxIter=4, maxDepth=2).fit(_known(_rows(s, d))), _rows(s, d)))
query("boosted_counts", Y + """, g AS (SELECT big, avg(y) AS m, any_value(f0) AS f0 FROM r, (SELECT ln(avg(y) + 1e-9) AS f0 FROM r WHERE y IS NOT NULL) WHERE y IS NOT NULL GROUP BY big),
 g1 AS (SELECT *, f0 + 0.3 * (m / exp(f0) - 1) AS f1 FROM g), g2 AS (SELECT *, f1 + 0.3 * (m / exp(f1) - 1) AS f2 FROM g1) SELECT cell, hour_ts, round(exp(f2 + 0.3 * (m / exp(f2) - 1)), 6) AS yhat FROM r JOIN g2 USING (big)""")(
    lambda s, d: _out(train.pipeline("boosted_trees", ["big"], objective="poisson", maxIter=3, maxDepth=2, stepSize=0.3).fit(_known(_rows(s, d))), _rows(s, d)))


@query("model_round_trip", MEANS + " UNION ALL SELECT cell, hour_ts, round(greatest(my + regr_a * (x2 - mx), 0), 6) FROM r, (SELECT avg(y) AS my, avg(x2) AS mx, regr_slope(y, x2) AS regr_a FROM r WHERE y IS NOT NULL)")
def _saved(s, d):
    """Two channels' models saved and loaded again by their channel."""
    rows, folder = _rows(s, d), work_folder(s, "models")
    sinks.save_model(train.pipeline("boosted_trees", ["big"], maxIter=2, maxDepth=2).fit(_known(rows)), folder, {"features": ["big"]}, "base")
    sinks.save_model(train.pipeline("linear", ["value"]).fit(_known(rows)), folder, {"features": ["value"]}, "rich")
    return _out(sinks.load_model(folder, "base")[0], rows).unionByName(_out(sinks.load_model(folder, "rich")[0], rows))


query("search_settings", "SELECT 'linear' AS model, NULL::DOUBLE AS reg, unnest([true, false]) AS intercept UNION ALL SELECT 'poisson', reg, icpt FROM (VALUES (0.0::DOUBLE), (0.1), (1.0), (10.0)) t(reg), (VALUES (true), (false)) u(icpt)")(
    lambda s, d: s.createDataFrame([(m, x.get("regParam"), x["fitIntercept"]) for m in ("linear", "poisson") for x in train.sampler(train.SPACES[m], train.TRIALS[m])], "model string, reg double, intercept boolean"))


@query("scoring_latency", "SELECT 100::BIGINT AS runs, true AS ordered, true AS positive")
def _latency(s, d):
    """What can be told of times: 100 runs, percentiles in order, a throughput."""
    rows = _known(_rows(s, d))
    t = train.latency(train.pipeline("linear", ["value"]).fit(rows), rows, runs=100)
    return s.createDataFrame([(100, t["p50_ms"] <= t["p95_ms"], t["rows_per_s"] > 0)], "runs long, ordered boolean, positive boolean")


# competition: baselines and least squares in one feature over the outer folds
FIT = """, f0 AS (SELECT max(hour_ts) AS m FROM t), f AS (SELECT k AS fold, m - INTERVAL 1 HOUR * (24 * k) AS test_end, m - INTERVAL 1 HOUR * (24 * k + 24) AS test_start, m - INTERVAL 1 HOUR * (24 * k + 25) AS train_end FROM f0, range(0, 3) x(k)),
 tr AS (SELECT f.fold, t.* FROM t, f WHERE y IS NOT NULL AND hour_ts < train_end), te AS (SELECT f.fold, t.* FROM t, f WHERE y IS NOT NULL AND hour_ts >= test_start AND hour_ts < test_end),
 ls AS (SELECT fold, regr_slope(y, value) AS a, regr_intercept(y, value) AS b, avg(y) AS my FROM tr GROUP BY fold), how AS (SELECT fold, cell, (isodow(hour_ts) - 1) * 24 + hour(hour_ts) AS how, avg(y) AS m FROM tr GROUP BY ALL),
 z AS (SELECT fold, 'persistence' AS model, y, incident_count::DOUBLE AS yhat FROM te UNION ALL SELECT te.fold, 'climatology', y, coalesce(m, my) FROM te JOIN ls USING (fold) LEFT JOIN how ON how.fold = te.fold AND how.cell = te.cell AND how.how = (isodow(te.hour_ts) - 1) * 24 + hour(te.hour_ts)
   UNION ALL SELECT te.fold, 'linear', y, greatest(b + a * value, 0) FROM te JOIN ls USING (fold)),
 s AS (SELECT fold, model, count(*) AS n, sqrt(avg((yhat - y) * (yhat - y))) AS rmse, avg(abs(yhat - y)) AS mae, CASE WHEN var_pop(y) > 0 THEN 1 - avg((yhat - y) * (yhat - y)) / var_pop(y) END AS r2, 100 * avg(abs(yhat - y) / (abs(y) + abs(yhat) + 1e-8)) AS smape, 100 * avg(CASE WHEN y > 0 THEN abs(yhat - y) / y END) AS mape FROM z GROUP BY ALL)"""
ONE = {"linear": {"fitIntercept": [True]}}
query("competition_folds", f", {T}" + FIT + " SELECT 'base' AS channel, model, fold, n, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2, round(smape, 6) AS smape, round(mape, 6) AS mape FROM s")(
    lambda s, d: train.compete(_target(s, d), {"base": ["value"]}, models=("linear",), spaces=ONE).drop("train_s"))
TIMED = ["train_time_sec", "inference_latency_p50_ms", "inference_latency_p95_ms", "rows_processed_per_sec"]
HOTSPOTS = [c for c in sinks.RESULTS if c.startswith(("hotspot", "staging"))]
query("competition_table", f", {T}" + FIT + " SELECT model AS model_name, 'base' AS channel, round(avg(rmse), 6) AS rmse, round(avg(mae), 6) AS mae, round(avg(r2), 6) AS r2, round(avg(smape), 6) AS smape, round(avg(mape), 6) AS mape_pos, CASE WHEN model = 'linear' THEN 'value' END AS top_5_features, model = 'linear' AS champion FROM s GROUP BY model")(
    lambda s, d: train.results_table(train.compete(_target(s, d), {"base": ["value"]}, models=("linear",), spaces=ONE, details=True, runs=2)).drop(*TIMED, *HOTSPOTS))

# experiments: least squares in one feature
ROB = f", {T}, q AS (SELECT cell, hour_ts, value, y, lead(incident_count, 3) OVER w AS y3, lead(incident_count, 6) OVER w AS y6, {DIGEST(42, 'cell')} % 100 < 20 AS held FROM t WINDOW w AS (PARTITION BY cell ORDER BY hour_ts)),"
ROB += """ v AS (SELECT *, epoch(hour_ts) AS sec FROM (SELECT 'horizon_1' AS experiment, value, y, hour_ts, held FROM q UNION ALL SELECT 'without_count', value, y, hour_ts, held FROM q UNION ALL SELECT 'horizon_3', value, y3, hour_ts, held FROM q UNION ALL SELECT 'horizon_6', value, y6, hour_ts, held FROM q UNION ALL SELECT 'cold_start', value, y, hour_ts, held FROM q) WHERE y IS NOT NULL),
 c AS (SELECT experiment, quantile_cont(sec, 0.8) AS cut FROM v GROUP BY 1), sp AS (SELECT v.*, CASE WHEN experiment = 'cold_start' THEN held ELSE sec > cut END AS test FROM v JOIN c USING (experiment)),
 ls AS (SELECT experiment, regr_slope(y, value) AS a, regr_intercept(y, value) AS b FROM sp WHERE NOT test GROUP BY 1), z AS (SELECT experiment, y, greatest(b + a * value, 0) AS yhat FROM sp JOIN ls USING (experiment) WHERE test) """
query("robustness_one_feature", ROB + REG.replace("SELECT count(*) AS n", "SELECT experiment, 1::BIGINT AS n_features, count(y) AS n").replace("FROM z WHERE y IS NOT NULL", "FROM (VALUES ('without_count'), ('horizon_1'), ('horizon_3'), ('horizon_6'), ('cold_start')) x(experiment) LEFT JOIN z USING (experiment) GROUP BY experiment"))(
    lambda s, d: train.robustness(_target(s, d), "linear", ["value"]))

# label audits: one 0/1 feature, whether the next row's value is large
BIN = ", t AS (SELECT cell, hour_ts, CAST(value > 250 AS INT) AS big, CAST(hour(hour_ts) >= 12 AS INT) AS late, CAST(lead(value) OVER (PARTITION BY cell ORDER BY hour_ts) > 200 AS INT) AS y FROM p)"
_binary = lambda s, d: P(s, d).select("cell", "hour_ts", (F.col("value") > 250).cast("int").alias("big"), (F.hour("hour_ts") >= 12).cast("int").alias("late"), (F.lead("value").over(Window.partitionBy("cell").orderBy("hour_ts")) > 200).cast("int").alias("y"))
SMOKE = BIN + f""", l AS (SELECT *, {{x}} AS x FROM t WHERE y IS NOT NULL), {FOLDS.format(step=24, w=24, n=3)}, tr AS (SELECT fold, x, avg(y) AS m FROM l, f WHERE hour_ts < train_end GROUP BY ALL),
 te AS (SELECT y, CAST(m > 0.5 AS INT) AS h FROM l, f JOIN tr USING (fold) WHERE tr.x = l.x AND hour_ts >= test_start AND hour_ts < test_end), c AS (SELECT y AS k, count(*) AS s, count(*) FILTER (y = h) AS tp FROM te GROUP BY y), m AS (SELECT h AS k, count(*) AS m FROM te GROUP BY h)
 SELECT '{{x}}' AS feature, round(sum(s * 2 * tp / (s + coalesce(m, 0))) / sum(s), 6) AS f1, round(sum(s * coalesce(tp / m, 0)) / sum(s), 6) AS precision, round(sum(tp) / sum(s), 6) AS recall, sum(s * 2 * tp / (s + coalesce(m, 0))) / sum(s) > 0.95 AS suspicious FROM c LEFT JOIN m USING (k)"""
query("single_feature_test", SMOKE.format(x="big"))(lambda s, d: train.smoke_test(_binary(s, d), ["big"], rounds=3))
PERM = BIN + f""", l AS (SELECT * FROM t WHERE y IS NOT NULL), cut AS (SELECT quantile_cont(epoch(hour_ts), 0.8) AS c FROM l), early AS (SELECT l.* FROM l, cut WHERE epoch(hour_ts) <= c), late_ AS (SELECT l.* FROM l, cut WHERE epoch(hour_ts) > c),
 runs AS (SELECT 0 AS run, big, y FROM early""" + "".join(f" UNION ALL SELECT {k}, a.big, b.y FROM (SELECT big, row_number() OVER (ORDER BY {DIGEST(7 + 2 * k, 'cell', 'hour_ts')}, cell, hour_ts) AS n FROM early) a JOIN (SELECT y, row_number() OVER (ORDER BY {DIGEST(8 + 2 * k, 'cell', 'hour_ts')}, cell, hour_ts) AS n FROM early) b USING (n)" for k in (1, 2, 3)) + """),
 g AS (SELECT run, big, avg(y) > 0.5 AS h FROM runs GROUP BY ALL), e2 AS (SELECT run, count(*) FILTER (h AND y = 1) AS tp, count(*) FILTER (h AND y = 0) AS fp, count(*) FILTER (NOT h AND y = 1) AS fn FROM late_ JOIN g USING (big) GROUP BY run)
 SELECT run::BIGINT AS run, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, (SELECT round(greatest(avg(y), 1 - avg(y)), 6) FROM late_) AS majority_share FROM e2"""
query("permuted_labels_test", PERM)(lambda s, d: train.permutation_test(_binary(s, d), ["big"]))
LABEL = "SELECT 'name' AS check, f AS subject, CAST(x AS DOUBLE) AS value, x AS suspicious FROM (VALUES ('big', false)) t(f, x)"
query("leakage_checks", ", " + FOLDS.format(step=24, w=24, n=3) + f", n AS ({LABEL}), x AS (SELECT fold, max(hour_ts) FILTER (hour_ts < train_end) AS train_max, min(hour_ts) FILTER (hour_ts >= test_start AND hour_ts < test_end) AS test_min, max(hour_ts) FILTER (hour_ts >= test_start AND hour_ts < test_end) AS test_max FROM p, f GROUP BY fold) SELECT * FROM n UNION ALL SELECT 'fold', CAST(fold AS VARCHAR), round((epoch_us(test_max) - epoch_us(test_min)) / 3.6e9, 6), NOT (train_max < test_min) FROM x UNION ALL SELECT 'duplicates', 'rows', 0.0::DOUBLE, false")(
    lambda s, d: train.leakage_suite(_binary(s, d), ["big"]).where("check in ('name', 'fold', 'duplicates')"))

# serving: the next three hours of each cell, from its last observation
SERVE = Y + """, ls AS (SELECT regr_slope(y, x2) AS a, regr_intercept(y, x2) AS b FROM r WHERE y IS NOT NULL), last AS (SELECT cell, max_by(value, hour_ts) AS value FROM p GROUP BY cell),
 g AS (SELECT cell, value, (SELECT max(hour_ts) FROM p) + INTERVAL 1 HOUR * k AS hour_ts FROM last, range(1, 4) x(k))"""
_first = lambda s, d: P(s, d).agg(F.max("hour_ts") + F.expr("interval 1 hour")).first()[0]
_served = lambda s, d: serve.serving_features(serve.serving_grid(P(s, d), str(_first(s, d)), 3), P(s, d).select("cell", "hour_ts", "value"), ["value", "hour_sin", "is_weekend", "not_there"])
query("serving_features", SERVE + " SELECT cell, hour_ts, round(value, 6) AS value, round(sin(hour(hour_ts) * (6.283185307179586 / 24)), 6) + 0.0 AS hour_sin, CAST(isodow(hour_ts) >= 6 AS BIGINT) AS is_weekend, 0.0::DOUBLE AS not_there, 1::BIGINT AS has_weather_data FROM g")(
    lambda s, d: _served(s, d).select("cell", "hour_ts", "value", (F.round("hour_sin", 6) + 0.0).alias("hour_sin"), "is_weekend", "not_there", "has_weather_data"))
query("batch_score", SERVE + " SELECT cell, hour_ts AS target_hour, round(greatest(b + a * value, 0), 6) AS predicted_incidents, 1::BIGINT AS has_weather_data, 'champion' AS model_name FROM g, ls")(
    lambda s, d: serve.score(train.pipeline("linear", ["value"]).fit(_known(_target(s, d))), _served(s, d)).drop("prediction_timestamp"))
