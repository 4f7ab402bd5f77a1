"""Time parts of an hour: calendar, bins, cyclic encodings, holidays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def floor_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def add_hours(ts: Column, hours: int) -> Column:
    return ts + F.expr(f"interval {hours} hours")


def hours_between(a: Column, b: Column) -> Column:
    """Absolute difference in hours."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return F.abs(micros(a) - micros(b)) / 3.6e9


def calendar(ts: Column) -> dict[str, Column]:
    """hour, day_of_week (Monday 0), day_of_month, month, is_weekend."""
    return {"hour": F.hour(ts), "day_of_week": F.weekday(ts), "day_of_month": F.dayofmonth(ts), "month": F.month(ts), "is_weekend": (F.weekday(ts) >= 5).cast("int")}


def extended_calendar(ts: Column) -> dict[str, Column]:
    return {
        "day_of_year": F.dayofyear(ts), "week_of_year": F.weekofyear(ts), "quarter": F.quarter(ts), "is_month_start": (F.dayofmonth(ts) == 1).cast("int"),
        "is_month_end": (F.to_date(ts) == F.last_day(ts)).cast("int"), "days_since_year_start": F.dayofyear(ts) - 1,
    }


def time_of_day_bucket(hour: Column, closed: str = "right") -> Column:
    """0 night to 5 late evening, cut at 6, 10, 14, 18 and 22; `closed` says to which side a cut hour belongs."""
    at = (lambda c: hour <= c) if closed == "right" else (lambda c: hour < c)
    return F.when(at(6), 0).when(at(10), 1).when(at(14), 2).when(at(18), 3).when(at(22), 4).otherwise(5)


def rush_hour(hour: Column) -> Column:
    """1 from 7 to 9, 2 from 17 to 19, else 0."""
    return F.when((hour >= 7) & (hour < 9), 1).when((hour >= 17) & (hour < 19), 2).otherwise(0)


def day_period(ts: Column) -> Column:
    """1 at weekends, else 0."""
    return (F.weekday(ts) >= 5).cast("int")


def cyclic(value: Column, period: float, name: str) -> dict[str, Column]:
    angle = value * (2 * math.pi / period)
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def hour_of_week(ts: Column) -> Column:
    return F.weekday(ts) * 24 + F.hour(ts)


def cyclic_calendar(ts: Column) -> dict[str, Column]:
    return cyclic(F.hour(ts), 24, "hour") | cyclic(F.weekday(ts), 7, "day_of_week") | cyclic(F.month(ts), 12, "month")


def wind_components(direction: Column) -> dict[str, Column]:
    return {"wind_direction_sin": F.sin(F.radians(direction)), "wind_direction_cos": F.cos(F.radians(direction))}


def day_name(ts: Column, prefix: str) -> Column:
    """The name of a day's file: prefix_2024-01-31."""
    return F.concat(F.lit(f"{prefix}_"), F.date_format(ts, "yyyy-MM-dd"))


def day_of_name(name: Column) -> Column:
    """The day that a file's name ends with, null where it ends otherwise."""
    return F.try_to_date(F.regexp_extract(name, "([0-9]{4}-[0-9]{2}-[0-9]{2})$", 1))


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(date) of the United States' federal holidays, from their rules; a few rows a year."""
    import datetime as dt

    def nth(y, m, weekday, n):
        d = dt.date(y, m, 1)
        return d + dt.timedelta((weekday - d.weekday()) % 7 + 7 * (n - 1))

    def last(y, m, weekday):
        d = dt.date(y, m + 1, 1) - dt.timedelta(1)
        return d - dt.timedelta((d.weekday() - weekday) % 7)

    days = []
    for y in range(first_year, last_year + 1):
        days += [dt.date(y, 1, 1), dt.date(y, 6, 19), dt.date(y, 7, 4), dt.date(y, 11, 11), dt.date(y, 12, 25)]
        days += [nth(y, 1, 0, 3), nth(y, 2, 0, 3), last(y, 5, 0), nth(y, 9, 0, 1), nth(y, 10, 0, 2), nth(y, 11, 3, 4)]
    return spark.createDataFrame([(d,) for d in days], "date date")


def holiday_flags(df: DataFrame, ts: str, days: DataFrame) -> DataFrame:
    """is_holiday, is_day_before_holiday, is_day_after_holiday (0/1), by one broadcast of the holiday table (bounded by its years)."""
    near = days.selectExpr("date as _d", "1 as h", "0 as b", "0 as a").union(days.selectExpr("date_sub(date, 1)", "0", "1", "0")).union(days.selectExpr("date_add(date, 1)", "0", "0", "1"))
    near = near.groupBy("_d").agg(F.max("h").alias("is_holiday"), F.max("b").alias("is_day_before_holiday"), F.max("a").alias("is_day_after_holiday"))
    return df.join(F.broadcast(near), F.to_date(ts) == F.col("_d"), "left").drop("_d").fillna(0, ["is_holiday", "is_day_before_holiday", "is_day_after_holiday"])
