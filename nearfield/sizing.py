"""Broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.session import work_dir

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def _row_bytes(df: DataFrame) -> Column:
    """Rough in-memory size of one row, from the column types."""
    total = F.lit(32)
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            part = F.octet_length(column)
        elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.ArrayType, T.StructType)):
            part = F.size(column) * 8
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            part = F.octet_length(F.to_json(F.struct(column)))
        else:
            part = F.lit(8)
        total = total + F.coalesce(part, F.lit(0))
    return total.cast("bigint")


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Measure rows and bytes with one distributed aggregate."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes


def broadcast_bounded(df: DataFrame, rows: int, row_bytes: int = 32) -> DataFrame:
    """Hint a broadcast for a table with a known bound on its rows, without running it."""
    fits = rows <= MAX_BROADCAST_ROWS and rows * row_bytes <= MAX_BROADCAST_BYTES
    return F.broadcast(df) if fits else df


TASK_BYTES = 128 * 1024 * 1024


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal an input that is read as fewer tasks than there are cores over all cores; a larger one stays where it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if estimate < cores * TASK_BYTES else df


def settle(df: DataFrame) -> DataFrame:
    """Compute a table once, into the shared folder."""
    path = f"{work_dir(df.sparkSession, 'settled')}/table"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def broadcast_if_small(
    df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """Hint a broadcast when the measured size allows it; otherwise leave the join to Spark.

    Without the hint the join falls back to a shuffle that adaptive execution may still
    turn into a broadcast or split where a key is skewed.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df
