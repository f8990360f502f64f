"""Paced ingest: rows laid out in load batches, streamed at a fixed number of batches per tick."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def effective_rate(rate: int, batch: int = 100) -> int:
    """The insert rate rounded down to a multiple of the batch size, at least one batch."""
    return rate if rate % batch == 0 else max(batch, rate // batch * batch)


def ideal_duration(size: int, rate: int) -> int:
    """Seconds a load at the given rate should take."""
    return math.ceil(size / rate)


def add_ticks(df: DataFrame, rate: int) -> DataFrame:
    """``tick`` of each row: its ``row_id`` over the rate, one tick per second."""
    return df.withColumn("tick", F.floor(F.col("row_id") / F.lit(rate)).cast("bigint"))


def write_ticks(df: DataFrame, path: str) -> T.StructType:
    """Store rows in one folder per tick; returns the schema to stream them with."""
    df.repartition("tick").write.mode("overwrite").partitionBy("tick").parquet(path)
    return df.schema


def read_ticks(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """The stored ticks as a stream, a bounded number of files per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def append_stream(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append every micro-batch to its own folder; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/micro={batch_id}")

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def read_appended(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """Everything appended so far."""
    return spark.read.schema(schema).option("basePath", out).parquet(f"{out}/micro=*")


def overrun_seconds(size: Column, rate: Column, actual_s: Column) -> Column:
    """Actual insert time beyond the ideal ``ceil(size / rate)`` seconds."""
    return actual_s - F.ceil(size / rate)
