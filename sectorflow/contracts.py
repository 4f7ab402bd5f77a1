"""Schemas of the layers, and how a table is brought to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

_f = lambda names, kind: [StructField(n, kind, True) for n in names.split()]

LOCATION = StructType([StructField("type", StringType()), StructField("coordinates", ArrayType(DoubleType()))])
EVENTS = StructType([*_f("incident_id", StringType()), *_f("timestamp", TimestampNTZType()), *_f("description status agency", StringType()), *_f("lat lon", DoubleType())])
OBSERVATIONS = StructType([*_f("timestamp", TimestampNTZType()), *_f("lat lon temperature dewpoint humidity wind_speed wind_direction precipitation_amount precipitation_probability weather_code", DoubleType()), *_f("data_source", StringType())])
PANEL = StructType([*_f("cell", LongType()), *_f("hour_ts", TimestampNTZType()), *_f("incident_count", LongType())])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and null both mean missing; only null is kept."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if f.dataType.typeName() in ("double", "float")})


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the columns of `schema`, cast where a value allows it, null where a column is missing."""
    have = set(df.columns)
    cols = [(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
    return nan_to_null(df.select(*cols))
