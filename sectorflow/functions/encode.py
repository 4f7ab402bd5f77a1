"""Encodings: one-hot, indicators, keyword classes, JSON, units."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes in the order they are tried, and their keywords.
KEYWORDS = {
    "CRASH": ["crash", "collision", "collisn", "auto/ped", "ped", "injury"],
    "HAZARDOUS CONDITION": ["traffic hazard", "trfc hazd", "vehicle fire", "blocked", "obstruct", "icy roadway"],
    "OTHER": ["stalled vehicle", "loose livestock"],
}


def classify(text: Column, keywords: dict[str, list[str]] = KEYWORDS, default: str = "OTHER", sure: float = 1.0, unsure: float = 0.9) -> tuple[Column, Column]:
    """Class and confidence: the first class with a keyword anywhere in the lower-cased text, else `default`."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = [(name, low.rlike("|".join(map(re.escape, words)))) for name, words in keywords.items()]
    label, conf = F.lit(default), F.lit(unsure)
    for name, cond in reversed(hit):
        label, conf = F.when(cond, name).otherwise(label), F.when(cond, sure).otherwise(conf)
    return label, conf


def categories(df: DataFrame, column: str) -> list:
    """Sorted distinct values: the one action that a data-dependent schema needs."""
    return sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())


def one_hot(df: DataFrame, column: str, values: list, drop_first: bool = True, drop_column: bool = True) -> DataFrame:
    """0/1 columns `<column>_<value>`; null gives all 0."""
    cols = {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in (values[1:] if drop_first else values)}
    out = df.withColumns(cols) if cols else df
    return out.drop(column) if drop_column else out


def flag(value: Column) -> Column:
    """0/1 with null as 0."""
    return F.coalesce(value.cast("int"), F.lit(0))


def precipitation_flags(amount: Column, probability: Column, p90: Column) -> dict[str, Column]:
    """Any rain, rain at or above its 90th percentile, chances of 50 and 80 percent or more; null counts as 0."""
    a, p = F.coalesce(amount, F.lit(0.0)), F.coalesce(probability, F.lit(0.0))
    return {"precip_any": (a > 0).cast("int"), "precip_heavy_p90": (a >= p90).cast("int"), "precip_prob_gt_50": (p >= 50).cast("int"), "precip_prob_gt_80": (p >= 80).cast("int")}


def fahrenheit(celsius: Column) -> Column:
    return celsius * 1.8 + 32


def dew_point(temperature: Column, humidity: Column) -> Column:
    """Rule of thumb: one degree below the temperature for every five points of humidity below 100."""
    return temperature - (100 - humidity) / 5


def json_number(text: Column, path: str) -> Column:
    return F.get_json_object(text, path).try_cast("double")


def numeric_columns(df: DataFrame) -> DataFrame:
    """Numeric columns, booleans as 0/1."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    num = ("byte", "short", "integer", "long", "float", "double")
    return df.select(*[F.col(c).cast("int").alias(c) if t == "boolean" else F.col(c) for c, t in kinds.items() if t in num or t == "boolean" or t.startswith("decimal")])


def without(df: DataFrame, part: str) -> DataFrame:
    """Without the columns whose name holds `part`."""
    return df.drop(*[c for c in df.columns if part in c])


#: Names such as temperature_lag_3h or humidity_rolling_mean_24h.
FEATURE = re.compile(r"^(?P<base>.+)_(?:(?P<lag>lag)_(?P<back>-?\d+)|rolling_(?P<stat>mean|max|min|std|cv|slope)_(?P<hours>\d+))h$")


def parse_feature(name: str) -> tuple[str, str, int] | None:
    """(base column, lag or statistic, hours) of a feature's name. A negative lag looks ahead."""
    m = FEATURE.match(name)
    return (m["base"], m["lag"] or m["stat"], int(m["back"] or m["hours"])) if m else None


#: Parts of names that stand for the target or what follows it; then our own names of targets.
SUSPICIOUS = ("incident_count", "incident_type", "severity", "vehicle_count", "cleared", "response", "target", "t_plus", "future", "lead", "label", "category")


def suspicious(names: list[str], parts=SUSPICIOUS) -> list[str]:
    """Names that hint at a leaked target, and lags that look ahead."""
    ahead = lambda n: (f := parse_feature(n)) is not None and f[1] == "lag" and f[2] < 0
    return [n for n in names if any(p in n.lower() for p in parts) or ahead(n)]


def feature_kind(name: str) -> str:
    """lag, rolling or base, by the name."""
    f = parse_feature(name)
    return "base" if f is None else "lag" if f[1] == "lag" else "rolling"


def zero_shot(text: Column, keywords: dict[str, list[str]] = KEYWORDS) -> tuple[Column, Column]:
    """Another name of `classify`: classes without training are found by keywords."""
    return classify(text, keywords)


def fit_labels(df: DataFrame, column: str) -> list:
    """Labels in order, from the rows to train on: the class of a label is its place."""
    return categories(df, column)


def encode_labels(column: Column, labels: list, unseen: int | None = None) -> Column:
    """The class number of a label, `unseen` for one that training did not have."""
    at = F.array_position(F.array(*[F.lit(x) for x in labels]), column) if labels else F.lit(0)
    return F.when(at > 0, (at - 1).cast("int")).otherwise(F.lit(unseen).cast("int"))


def decode_labels(number: Column, labels: list) -> Column:
    """The label of a class number, null where there is none."""
    return F.try_element_at(F.array(*[F.lit(x) for x in labels]), number + 1)
