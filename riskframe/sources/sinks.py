"""Sinks and catalog description."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.session import table_path


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> str:
    """CSV with a header row (one file per partition; Parquet is the default sink)."""
    df.write.mode("overwrite").options(header=True, encoding=encoding).csv(path)
    return path


def export_csv(df: DataFrame, folder: str, name: str, now: dt.datetime, encoding: str = "UTF-8") -> str:
    """The download form: ``<name>_<date>_<time>.csv`` with a byte-order mark before each file's
    header, so spreadsheet programs read it as UTF-8.  Returns the path."""
    path = f"{folder}/{name}_{now:%Y%m%d_%H%M%S}.csv"
    first, *rest = df.columns
    return write_csv(df.toDF("\ufeff" + first, *rest), path, encoding)


def append_facts(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append scored rows to the fact table (Parquet, optionally partitioned)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_batch_idempotent(df: DataFrame, path: str, batch_id: int) -> None:
    """S10/ST1: write one micro-batch under its own ``batch_id`` partition, overwriting it,
    so a retried batch replaces its earlier output instead of duplicating it."""
    (df.withColumn("batch_id", F.lit(int(batch_id))).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def describe_tables(spark: SparkSession, sf_dir: str, tables: list[str]) -> DataFrame:
    """Every table with its column count, column list and row count (row counts from
    Parquet metadata: Spark's count reads no column data)."""
    parts = []
    for t in tables:
        df = spark.read.parquet(table_path(sf_dir, t))
        cols = ", ".join(f"{n} {ty}" for n, ty in df.dtypes)
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(t).alias("table_name"), F.lit(len(df.columns)).alias("n_columns"),
            F.lit(cols).alias("columns"), "n_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
