"""Leakage audits: features recomputed another way, fold bounds, duplicates, variance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encode import parse_feature
from .ordered import number_by_hash
from .windows import lags, rolling_rows


def audit_features(df: DataFrame, base_columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(feature, checked, mismatches): each lag and rolling column against its recomputation by collected histories: a
    formulation of its own, arrays of the rows up to the current one rather than frames. A lag below 0 looks ahead: all its
    values are mismatches, whatever they are."""
    names = [n for n in df.columns if (f := parse_feature(n)) and f[0] in base_columns and f[1] in ("lag", "mean", "max", "min", "std")]
    ahead = {n for n in names if parse_feature(n)[1] == "lag" and parse_feature(n)[2] < 0}
    from pyspark.sql import Window

    w = Window.partitionBy("cell").orderBy("hour_ts")
    most = max([parse_feature(n)[2] for n in names if n not in ahead], default=1)
    hist = {c: F.collect_list(F.struct(F.col(c).alias("v"))).over(w.rowsBetween(-most, 0)) for c in {parse_feature(n)[0] for n in names}}
    out = df.withColumns({f"_h_{c}": h for c, h in hist.items()})
    checks = []
    for n in names:
        c, kind, k = parse_feature(n)
        h = F.col(f"_h_{c}")
        if n in ahead:
            checks.append(F.count(n).alias(n))
            continue
        if kind == "lag":
            want = F.try_element_at(F.reverse(h), F.lit(k + 1))["v"]
        else:
            last = F.filter(F.transform(F.slice(F.reverse(h), 1, k), lambda s: s["v"].cast("double")), lambda v: v.isNotNull())
            want = {"max": F.array_max(last), "min": F.array_min(last), "mean": F.when(F.size(last) > 0, _mean(last)), "std": F.when(F.size(last) > 1, _std(last))}[kind]
        same = F.col(n).cast("double").eqNullSafe(want.cast("double")) | (F.abs(F.col(n) - want) <= tolerance)
        checks.append(F.count(F.when(~F.coalesce(same, F.lit(False)), 1)).alias(n))
    if not names:
        return df.sparkSession.createDataFrame([], "feature string, checked long, mismatches long")
    one = out.agg(F.count("*").alias("_n"), *checks)
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col("_n").alias("checked"), F.col(n).alias("mismatches")) for n in names])).alias("x")).select("x.*")


def _mean(xs):
    return F.aggregate(xs, F.lit(0.0), lambda a, v: a + v) / F.size(xs)


def _std(xs):
    """Sample standard deviation; the mean is bound once by a one-element array."""
    return F.transform(F.array(_mean(xs)), lambda m: F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / (F.size(xs) - 1)))[0]


def history_in_time(df: DataFrame, column: str, hours: int, by: list[str], ts: str = "hour_ts") -> DataFrame:
    """(by, ts, mean, std, min, max, n) of each row's values at times within [t - hours, t], both ends in: what a rolling feature over
    time should be, by a join on buckets of `hours` and an aggregate, without any frame."""
    at, width = F.unix_micros(F.col(ts).cast("timestamp")), hours * 3_600_000_000
    own = df.select(*by, ts, at.alias("_t")).distinct().withColumn("_b", F.explode(F.array(F.floor(F.col("_t") / width), F.floor(F.col("_t") / width) - 1)))
    past = df.select(*by, at.alias("_s"), F.floor(at / width).alias("_b"), F.col(column).alias("_v"))
    both = own.join(past, [*by, "_b"]).where((F.col("_s") <= F.col("_t")) & (F.col("_s") >= F.col("_t") - width))
    return both.groupBy(*by, ts).agg(F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.count("_v").alias("n"))


def build_and_audit(panel: DataFrame, column: str) -> DataFrame:
    return audit_features(rolling_rows(lags(panel, [column], (1, 3)), [column], (3, 6), ("mean", "max")), [column])


def audit_folds(rows: DataFrame, ts: str = "hour_ts") -> DataFrame:
    """(fold, n_train, n_test, train_max, test_min, ordered, span_hours) of rows with fold and role."""
    is_ = lambda r: F.col("role") == r
    g = rows.groupBy("fold").agg(F.count(F.when(is_("train"), 1)).alias("n_train"), F.count(F.when(is_("test"), 1)).alias("n_test"), F.max(F.when(is_("train"), F.col(ts))).alias("train_max"), F.min(F.when(is_("test"), F.col(ts))).alias("test_min"), F.max(F.when(is_("test"), F.col(ts))).alias("test_max"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return g.select("fold", "n_train", "n_test", "train_max", "test_min", (F.col("train_max") < F.col("test_min")).alias("ordered"), ((micros("test_max") - micros("test_min")) / 3.6e9).alias("span_hours"))


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(rows, distinct_rows, duplicates) by whole rows."""
    cols = columns or df.columns
    g = df.groupBy(*cols).agg(F.count("*").alias("_n"))
    return g.agg(F.sum("_n").cast("long").alias("rows"), F.count("*").alias("distinct_rows"), F.sum(F.col("_n") - 1).cast("long").alias("duplicates"))


def variances(df: DataFrame, columns: list[str], top: int = 50) -> DataFrame:
    """(feature, variance) of the columns with the largest sample variance."""
    one = df.agg(*[F.var_samp(c).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance")) for c in columns])).alias("x")).select("x.*").orderBy(F.desc_nulls_last("variance"), "feature").limit(top)


def class_share(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share)."""
    total = df.agg(F.count("*").alias("_t"))
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("_t")).alias("share"))


def permute(df: DataFrame, column: str, key: str | list[str], seed: int = 7) -> DataFrame:
    """The column's values dealt anew over the rows: two orders, by a hash of the key and by another, matched by number."""
    keys = [key] if isinstance(key, str) else list(key)
    dealt = number_by_hash(df.select(*keys, F.col(column).alias(f"{column}_permuted")), keys, seed + 1).drop(*keys)
    return number_by_hash(df, keys, seed).join(dealt, "_n").drop("_n")
