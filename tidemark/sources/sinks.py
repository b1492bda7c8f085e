"""Result sinks: file sets, partitioned trees, keyed upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.tables import keep_last


def save_results(folder: str, tables: Mapping[str, DataFrame], fmt: str = "parquet") -> dict[str, str]:
    """One folder per result table."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder}/{name}"
        writer = df.write.mode("overwrite")
        writer.option("header", True).csv(paths[name]) if fmt == "csv" else writer.parquet(paths[name])
    return paths


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_")


def save_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("asset_group", "symbol_file"), only_present: bool = False) -> None:
    """A folder per asset group and symbol; rows are clustered first so each folder gets few files.

    ``only_present`` replaces the folders that ``df`` has rows for and leaves the others as they are.
    """
    df = df.withColumn("symbol_file", safe_name(F.col("symbol")))
    mode = "dynamic" if only_present else "static"
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*by).parquet(path)


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Latest version per key after applying ``changes``; the caller writes it to a new version folder."""
    return keep_last(current.unionByName(changes, allowMissingColumns=True), keys, seq)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def run_snapshots(snapshots: DataFrame, run_id: str, order: str = "ts") -> DataFrame:
    return snapshots.where(F.col("run_id") == run_id).orderBy(order)
