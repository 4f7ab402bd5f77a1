"""Nearest, as-of and radius joins as equi-joins on buckets with a residual condition."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import HexGrid, haversine_km
from ..functions.temporal import hours_between


def fuzzy_nearest(events: DataFrame, obs: DataFrame, key: str, values: list[str], grid: HexGrid = HexGrid(), k: int = 1, max_km: float = 50.0, max_hours: float = 1.0, spatial_weight: float = 1.0, temporal_weight: float = 0.5, obs_id: str = "obs_id") -> DataFrame:
    """All events, each with the nearest observation in space and time, or nulls.

    Candidates share the cell neighbourhood and are within max_km and max_hours (inclusive). Score: spatial_weight * km +
    temporal_weight * 50 * hours; the smallest wins, equal ones (to 9 decimals) by obs_id. Adds weather_<value>,
    weather_distance_km, weather_time_diff_hours, weather_combined_score. Events without valid coordinates keep nulls.

    Plan: observations are multiplied by the cells and hour buckets from which they can be reached, then one equi-join on
    (cell, bucket) with the distances as residual, one partial aggregate for the winner, one join back on the key.
    """
    step = max(1, math.ceil(max_hours))
    bucket = lambda ts: F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(3_600_000_000 * step))
    e = events.select(F.col(key).alias("_key"), F.col("ts").alias("_ts"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), grid.cell(F.col("lat"), F.col("lon")).alias("_cell"), bucket(F.col("ts")).alias("_b")).where("_cell is not null and _ts is not null")
    o = obs.select(F.col(obs_id).alias("_oid"), F.col("ts").alias("_ots"), F.col("lat").alias("_olat"), F.col("lon").alias("_olon"), *[F.col(v).alias(f"_v_{v}") for v in values], grid.cell(F.col("lat"), F.col("lon")).alias("_home"), bucket(F.col("ts")).alias("_h")).where("_home is not null and _ots is not null")
    o = o.withColumn("_cell", F.explode(grid.neighbors(F.col("_home"), k))).withColumn("_b", F.explode(F.array(F.col("_h") - 1, F.col("_h"), F.col("_h") + 1)))
    km, dt = haversine_km(F.col("_lat"), F.col("_lon"), F.col("_olat"), F.col("_olon")), hours_between(F.col("_ts"), F.col("_ots"))
    c = e.join(o, ["_cell", "_b"]).withColumns({"_km": km, "_dt": dt}).where((F.col("_km") <= max_km) & (F.col("_dt") <= max_hours))
    score = F.round(spatial_weight * F.col("_km") + temporal_weight * 50 * F.col("_dt"), 9)
    got = F.struct(*[F.col(f"_v_{v}").alias(f"weather_{v}") for v in values], F.col("_km").alias("weather_distance_km"), F.col("_dt").alias("weather_time_diff_hours"), score.alias("weather_combined_score"), F.col("_home").alias("weather_cell"))
    best = c.groupBy("_key").agg(F.min_by(got, F.struct(score.alias("s"), F.col("_oid"))).alias("_got")).select(F.col("_key").alias(key), "_got.*")
    return events.join(best, key, "left")


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], direction: str = "backward", prefix: str = "", bucket_hours: int = 24) -> DataFrame:
    """Each left row with the last right row at or before it (backward) or the first at or after it (forward), within `by`.

    One union and one window: no candidate pairs. The window is within `by` and a time bucket, so a busy key is many tasks;
    what a bucket inherits from those before it (after it) is a row for each key and bucket. Of right rows with equal
    time, the one with the largest values counts. A null time finds nothing; null keys are equal to each other.
    """
    names, back = [f"{prefix}{v}" for v in values], direction == "backward"
    at = F.floor(F.unix_micros(F.col(on).cast("timestamp")) / F.lit(bucket_hours * 3_600_000_000)).alias("_b")
    rows = right.where(F.col(on).isNotNull()).groupBy(*by, on).agg(F.max(F.struct(*values)).alias("_v")).select(*by, on, "_v", at)
    both = left.select("*", at).withColumn("_v", F.lit(None).cast(rows.schema["_v"].dataType)).withColumn("_side", F.lit(1))
    both = both.unionByName(rows.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    order = F.col(on) if back else F.col(on).desc()
    got = F.last("_v", ignorenulls=True).over(Window.partitionBy(*by, "_b").orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0))
    edge = both.groupBy(*by, "_b").agg((F.max_by if back else F.min_by)("_v", F.when(F.col("_side") == 0, F.col(on))).alias("_edge"))
    beyond = Window.partitionBy(*by).orderBy(F.col("_b") if back else F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = edge.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_b"])], F.last("_edge", ignorenulls=True).over(beyond).alias("_carry"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, "_b"])]
    out = both.withColumn("_got", got).where("_side = 1").join(carry, same, "left")
    best = F.when(F.col(on).isNotNull(), F.coalesce("_got", "_carry"))
    return out.withColumn("_got", best).select(*left.columns, *[F.col("_got")[v].alias(n) for v, n in zip(values, names, strict=True)])


def time_lag(df: DataFrame, on: str, by: list[str], column: str, hours: int) -> DataFrame:
    """<column>_lag_<h>h: the last value at or before t - h, by as-of on times moved forward. It never looks ahead."""
    moved = df.select(*by, (F.col(on) + F.expr(f"interval {hours} hours")).alias(on), F.col(column).alias(f"{column}_lag_{hours}h"))
    return asof(df, moved, on, by, [f"{column}_lag_{hours}h"])


def radius_window(events: DataFrame, key: str, km: float = 1.5, hours=(1, 24), means: tuple[str, ...] = ()) -> DataFrame:
    """nearby_count_<w>h and nearby_avg_<column>_<w>h over other events in [t - w, t) within km; counts default to 0, means to null.

    Bands of latitude a little wider than the radius, squares within a band, and time buckets of the widest window make it an
    equi-join with a bounded number of buckets to visit: 3 x 3 squares and 2 buckets. A band has squares of its own width,
    from the highest latitude next to it, so events near a pole, where a band is one square, widen no others'. All windows come from one join, whose
    hot squares the engine splits.
    """
    top, side = max(hours), 1.01 * km
    band = F.floor(F.col("lat") * 111.19 / side)
    edge = lambda b: F.greatest(F.abs(b - 1), F.abs(b + 2)) * (side / 111.19)  # noqa: E731  a band's and its neighbours' highest latitude
    polar = math.degrees(math.acos(min(1.0, 10 * km / 6371)))  # beyond, all longitudes are near each other: one square
    square = lambda b: F.when(edge(b) >= polar, 0).otherwise(F.floor(F.col("lon") * 111.19 * F.cos(F.radians(F.least(edge(b), F.lit(polar)))) / side))
    e = events.withColumns({"_gx": band, "_u": F.unix_micros(F.col("ts").cast("timestamp"))}).withColumns({"_gy": square(F.col("_gx")), "_tb": F.floor(F.col("_u") / F.lit(top * 3_600_000_000))})
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    left = e.select(F.col(key).alias("_key"), F.col("_u").alias("_u1"), F.col("lat").alias("_lat1"), F.col("lon").alias("_lon1"), "lon", F.explode(F.transform(step, lambda d: F.col("_gx") + d)).alias("_gx"), "_tb")
    left = left.withColumn("_dy", F.explode(step)).withColumn("_db", F.explode(F.array(F.lit(-1), F.lit(0))))
    left = left.select("_key", "_u1", "_lat1", "_lon1", "_gx", (square(F.col("_gx")) + F.col("_dy")).alias("_gy"), (F.col("_tb") + F.col("_db")).alias("_tb"))
    right = e.select(F.col(key).alias("_key2"), F.col("_u").alias("_u2"), F.col("lat").alias("_lat2"), F.col("lon").alias("_lon2"), "_gx", "_gy", "_tb", *means)
    # neither side may be broadcast: estimates come from compressed files and do not know of the 18 copies
    pair = left.join(right.hint("merge"), ["_gx", "_gy", "_tb"]).where((F.col("_u2") < F.col("_u1")) & (F.col("_u2") >= F.col("_u1") - top * 3_600_000_000) & (F.col("_key") != F.col("_key2")))
    pair = pair.where(haversine_km(F.col("_lat1"), F.col("_lon1"), F.col("_lat2"), F.col("_lon2")) <= km)
    inside = lambda w: F.col("_u2") >= F.col("_u1") - w * 3_600_000_000
    aggs = [F.count(F.when(inside(w), 1)).alias(f"nearby_count_{w}h") for w in hours] + [F.avg(F.when(inside(w), F.col(m))).alias(f"nearby_avg_{m}_{w}h") for w in hours for m in means]
    got = pair.groupBy("_key").agg(*aggs)
    return events.join(got, events[key] == got["_key"], "left").drop("_key").fillna(0, [f"nearby_count_{w}h" for w in hours])


def neighbor_edges(cells: DataFrame, grid: HexGrid = HexGrid(), k: int = 1, with_self: bool = True) -> DataFrame:
    """(cell, neighbor) of the distinct cells."""
    return cells.select("cell").distinct().select("cell", F.explode(grid.neighbors(F.col("cell"), k, with_self=with_self)).alias("neighbor"))


def neighbor_aggregates(panel: DataFrame, columns: list[str], grid: HexGrid = HexGrid(), k: int = 1, aggs=("mean", "max", "sum"), delta: bool = True) -> DataFrame:
    """spatial_<agg>_<column>_k<k> over the cells within k at the same hour (the own one included), and <column>_minus_neighbor_mean_k<k>.

    Each row is sent to the cells it is a neighbour of and summed there before the join back: one shuffle of the narrow rows.
    """
    fn = {"mean": F.avg, "max": F.max, "sum": F.sum}
    sent = panel.select(F.explode(grid.neighbors(F.col("cell"), k)).alias("cell"), "hour_ts", *columns)
    got = sent.groupBy("cell", "hour_ts").agg(*[fn[a](c).alias(f"spatial_{a}_{c}_k{k}") for c in columns for a in aggs])
    out = panel.join(got, ["cell", "hour_ts"], "left")
    return out.withColumns({f"{c}_minus_neighbor_mean_k{k}": F.col(c) - F.col(f"spatial_mean_{c}_k{k}") for c in columns}) if delta and "mean" in aggs else out


def nearest_hour(obs: DataFrame, wanted: DataFrame, by: list[str], ts: str = "hour_ts") -> DataFrame:
    """For each wanted (by, hour), the observation of the exact hour, else that of the nearest; earlier on ties. Wanted
    rows whose key has no observation go. Two as-of joins, so a key's observations are never paired with all its hours."""
    rest = [c for c in obs.columns if c not in (*by, ts)]
    o = obs.withColumn("_ots", F.col(ts))
    both = asof(wanted.select(*by, ts).distinct(), o, ts, by, ["_ots", *rest], prefix="_a_")
    both = asof(both, o, ts, by, ["_ots", *rest], "forward", "_z_")
    gap = lambda c: hours_between(F.col(c), F.col(ts))
    earlier = F.col("_z__ots").isNull() | (gap("_a__ots") <= gap("_z__ots"))
    both = both.where(F.coalesce("_a__ots", "_z__ots").isNotNull())
    return both.select(*by, ts, *[F.when(earlier, F.col(f"_a_{c}")).otherwise(F.col(f"_z_{c}")).alias(c) for c in rest])
