"""Total orders without a window over one partition: range buckets, ordered inside, and offsets between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digest import DIGITS, digest

BITS = 12  # 4096 buckets, so what goes between them is as many rows at most


def number_by_hash(df: DataFrame, keys: list[str], seed: int, name: str = "_n") -> DataFrame:
    """Numbers from 1 in the order of a seeded hash of `keys`, ties by the keys; rows that repeat a key are ordered among themselves at will."""
    h = df.withColumn("_h", digest(seed, *keys)).withColumn("_bucket", F.shiftright("_h", 4 * DIGITS - BITS))
    before = running_total(h.groupBy("_bucket").agg(F.count("*").alias("_c")), "_bucket", ["_c"])
    w = Window.partitionBy("_bucket").orderBy("_h", *keys)
    out = h.withColumn(name, F.row_number().over(w)).join(F.broadcast(before), "_bucket")
    return out.withColumn(name, F.col(name) + F.col("_c_before")).drop("_h", "_bucket", "_c_before")


def running_total(buckets: DataFrame, bucket: str, amounts: list[str]) -> DataFrame:
    """(bucket, <amount>_before): sums over the smaller buckets. The table has a row a bucket, a bounded number."""
    w = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return buckets.select(bucket, *[F.coalesce(F.sum(a).over(w), F.lit(0)).alias(f"{a}_before") for a in amounts])


def cumulative(df: DataFrame, by: str, amounts: list[str], buckets: int = 256) -> DataFrame:
    """<amount>_upto: sum over the rows with a value of `by` at or below the row's own, `by` being distinct. Buckets between
    approximate quantiles of `by`, so that each has about as many rows, however the values lie."""
    bounds = df.agg(F.percentile_approx(by, [i / buckets for i in range(1, buckets)]).alias("_bounds"))  # one row
    at: Column = F.size(F.filter("_bounds", lambda x: x < F.col(by)))
    rows = df.crossJoin(F.broadcast(bounds)).withColumn("_bucket", at).drop("_bounds")
    before = running_total(rows.groupBy("_bucket").agg(*[F.sum(a).alias(a) for a in amounts]), "_bucket", amounts)
    w = Window.partitionBy("_bucket").orderBy(by)
    out = rows.join(F.broadcast(before), "_bucket")
    return out.withColumns({f"{a}_upto": F.sum(a).over(w) + F.col(f"{a}_before") for a in amounts}).drop("_bucket", *[f"{a}_before" for a in amounts])


def exact_quantiles(df: DataFrame, column: str, shares: list[float], bins: int = 1024, few: int = 100_000) -> list[float | None]:
    """Exact quantiles of a numeric column, between two neighbours by linear interpolation; null for a column without values.

    Selection by histograms: a scan counts the values in `bins` equal steps of a range, the step that holds the wanted rank
    is the next range, until it holds one value or `few` distinct ones at most. A task sends `bins` rows, whatever there is;
    the engine's own exact percentile would bring all distinct values into one task.
    """
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"))
    all_ = rows.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not all_["n"]:
        return [None] * len(shares)

    def at(rank: int) -> float:
        lo, hi, n, before = all_["lo"], all_["hi"], all_["n"], 0
        while lo < hi and n > few:
            step = F.least(F.floor((F.col("x") - lo) / (hi - lo) * bins), F.lit(bins - 1))
            part = rows.where(F.col("x").between(lo, hi)).groupBy(step.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            for r in sorted(part.collect(), key=lambda r: r["b"]):
                if before + r["n"] > rank:
                    lo, hi, n = r["lo"], r["hi"], r["n"]
                    break
                before += r["n"]
        if lo == hi:
            return lo
        for r in rows.where(F.col("x").between(lo, hi)).groupBy("x").agg(F.count("*").alias("n")).orderBy("x").collect():  # `few` rows at most
            before += r["n"]
            if before > rank:
                return r["x"]
        return hi

    found: dict[int, float] = {}
    out = []
    for q in shares:
        place = q * (all_["n"] - 1)
        i = int(place)
        for r in {i, min(i + 1, all_["n"] - 1)}:
            found[r] = found[r] if r in found else at(r)
        up = found[min(i + 1, all_["n"] - 1)]
        out.append(found[i] + (up - found[i]) * (place - i))
    return out
