"""Run a streaming plan over what is available now and return its result table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> None:
    """State too large for memory and ``transformWithState`` both need the RocksDB provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, which the driver and all executors reach."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def available_now(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Append results to a Parquet folder (the caller's, or a new shared one) and read them back."""
    spark = stream.sparkSession
    stateful(spark)
    base = folder or shared_folder(spark, "stream")
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/rows")
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def land(df: DataFrame, column: str, parts: int = 4, delay: Column | None = None, folder: str | None = None) -> str:
    """Write a table as files that arrive one after the other: equal spans of ``column``, each ``delay`` parts late.

    A few files stand for days of arrivals; every file becomes a micro-batch of ``arrivals``.
    """
    folder = folder or shared_folder(df.sparkSession, "landed")
    at = F.unix_micros(column)
    lo, hi = df.agg(F.min(at), F.max(at)).first()
    span = max((hi or 0) - (lo or 0) + 1, 1)
    part = F.floor((at - F.lit(lo or 0)) / F.lit(span) * parts).cast("int")
    df = df.withColumn("_part", F.coalesce(part, F.lit(0)) + (F.coalesce(delay, F.lit(0)) if delay is not None else F.lit(0)))
    last = df.agg(F.max("_part")).first()[0] or 0
    for i in range(last + 1):
        df.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(folder)
    return folder


def arrivals(like: DataFrame, folder: str, per_trigger: int = 1) -> DataFrame:
    """The landed files in their order of arrival."""
    return like.sparkSession.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
