"""Sinks: date partitions, single or chunked files, CSV and JSON results, models, metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_date(df: DataFrame, folder: str, ts: str = "timestamp") -> None:
    """One partition a day; days that are written again replace themselves only."""
    out = df.withColumn("date", F.to_date(ts))
    out.repartition("date").write.partitionBy("date").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def write_silver(df: DataFrame, folder: str, single_file: bool = True, max_rows: int = 1_000_000) -> None:
    """One file, for tables that are small by contract, or files of at most max_rows."""
    if single_file:
        df.coalesce(1).write.mode("overwrite").parquet(folder)
    else:
        df.write.mode("overwrite").option("maxRecordsPerFile", max_rows).parquet(folder)


def metadata(df: DataFrame, ts: str | None = "timestamp", **extra) -> dict:
    """Row count, columns and time range as SQL prints times (no zeros at the end of a fraction, null without rows), by one aggregate."""
    aggs = [F.count("*").alias("n")] + ([F.min(ts).cast("string").alias("a"), F.max(ts).cast("string").alias("b")] if ts else [])
    r = df.agg(*aggs).first()
    return {"row_count": r["n"], "columns": df.columns, "date_range": [r["a"], r["b"]] if ts else None} | extra


def target_metadata(df: DataFrame, column: str, **extra) -> dict:
    """Row count, columns and how often each class occurs."""
    shares = {str(r[0]): r[1] for r in df.groupBy(column).count().collect()}  # a row a class
    return {"row_count": sum(shares.values()), "target_columns": df.columns, "target_distribution": shares} | extra


def panel_metadata(df: DataFrame, keys: tuple[str, ...] = ("cell", "hour_ts"), ts: str = "hour_ts", **parameters) -> dict:
    """Metadata of the panel with the parameters of its joins."""
    return metadata(df, ts, aggregation_level="sector_hour", primary_key=list(keys), merge_parameters=parameters, feature_columns=[c for c in df.columns if c not in keys])


def observation_metadata(df: DataFrame) -> dict:
    """The same, with how many locations and which sources there are."""
    r = df.agg(F.count_distinct("lat", "lon").alias("n"), F.sort_array(F.collect_set("data_source")).alias("s")).first()
    return metadata(df, locations=r["n"], data_sources=r["s"])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file by the cluster's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, indent=2, default=str))


#: Columns of the results table, in order.
RESULTS = [
    "model_name", "channel", "rmse", "mae", "r2", "smape", "mape_pos", "hotspot_precision_at_k", "hotspot_recall_at_k", "hotspot_precision_at_k_conditional", "hotspot_recall_at_k_conditional",
    "staging_utility_coverage_pct", "staging_utility_with_neighbors_pct", "train_time_sec", "inference_latency_p50_ms", "inference_latency_p95_ms", "rows_processed_per_sec", "top_5_features", "champion",
]


def write_results(df: DataFrame, folder: str, columns: list[str] = RESULTS) -> None:
    have = set(df.columns)
    cols = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]
    df.select(*cols).coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file whole."""
    return spark.read.text(path, wholetext=True).first()[0]


def save_model(model, folder: str, meta: dict, channel: str = "rich") -> None:
    """The champion of a channel; the metadata name all channels that were saved."""
    spark = SparkSession.active()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/model_metadata.json")
    known = json.loads(read_text(spark, str(path.toString()))) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else {}
    model.write().overwrite().save(f"{folder}/{channel}")
    write_json(spark, f"{folder}/model_metadata.json", known | {channel: meta})


def load_model(folder: str, channel: str = "rich"):
    """(model, metadata) of a channel; an error names the channels there are."""
    from pyspark.ml import PipelineModel

    known = json.loads(read_text(SparkSession.active(), f"{folder}/model_metadata.json"))
    if channel not in known:
        raise ValueError(f"no model for {channel}; there are {sorted(known)}")
    return PipelineModel.load(f"{folder}/{channel}"), known[channel]
