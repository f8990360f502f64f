"""Sharding by extendible hashing.

Each row has a string of hash bits. The directory starts with one bucket; a bucket over the
byte limit, and no other, splits on the next bit until every bucket fits. The sizes of all
buckets of all depths come from one histogram over fine cells, about sixteen to a shard, so
the number of jobs does not depend on the number of splits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import stored
from nearfield.sizing import broadcast_if_small

LIMIT_BYTES = 2 << 20
KEY_BITS = 60
ALL_BITS = 2 * KEY_BITS
_FINER = 4
_RANGE = 10


def _bits(text: Column) -> Column:
    """The first 60 bits of the MD5 of a text, as a string of 0 and 1."""
    return F.lpad(F.bin(F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("bigint")), KEY_BITS, "0")


def _hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Bits of the key, then bits of the row's place, which part rows that repeat one key."""
    place = F.monotonically_increasing_id().cast("string")
    return docs.withColumns(
        {
            "__bytes": F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("bigint"),
            "__bits": F.concat(_bits(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), _bits(place)),
        }
    )


def _fits(limit: int) -> Column:
    return (F.col("bytes") <= limit) | (F.col("rows") == 1)


def _level(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """For each cell of ``high`` bits the depth, from ``low`` on, of the bucket that holds it; null if the cell itself must split."""
    cells = stored(rows.groupBy(F.substring("__bits", 1, high).alias("cell")).agg(F.sum("__bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")), "cells")
    depths = cells.select("cell", "bytes", "rows", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("bucket", F.expr("substring(cell, 1, depth)"))
    buckets = depths.groupBy("bucket", "depth").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).where(_fits(limit))
    chosen = depths.select("cell", "bucket", "depth").join(buckets, ["bucket", "depth"]).groupBy("cell").agg(F.min_by(F.struct("depth", "bytes"), "depth").alias("b"))
    return stored(cells.select("cell").join(chosen.select("cell", F.col("b.depth").cast("int").alias("depth"), "b.bytes"), "cell", "left"), "directory")


def directory(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """Directory tables ``cell, depth, bytes`` with the number of bits of their cells; each next one is about the cells the last left open."""
    total, count = rows.agg(F.coalesce(F.sum("__bytes"), F.lit(0)), F.count(F.lit(1))).first()
    if not count:
        return []
    high = min(KEY_BITS, math.ceil(math.log2(max(1, total / limit))) + _FINER)
    low = max(0, high - _RANGE)
    found = _level(rows, low, high, limit)
    if low and not found.where(F.col("depth") == low).isEmpty():
        found = _level(rows, 0, high, limit)
    levels = [(high, found)]
    while high < ALL_BITS and not found.where(F.col("depth").isNull()).isEmpty():
        rows = _split(rows, high, found).where(F.col("depth").isNull()).drop("depth", "bytes")
        low, high = high + 1, KEY_BITS if high < KEY_BITS else min(ALL_BITS, high + _RANGE)
        found = _level(rows, low, high, limit)
        levels.append((high, found))
    return levels


def _split(rows: DataFrame, high: int, found: DataFrame) -> DataFrame:
    return rows.withColumn("cell", F.substring("__bits", 1, high)).join(broadcast_if_small(found), "cell").drop("cell")


def _placed(rows: DataFrame, levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """Rows with ``__depth``, ``__shard_bytes`` and ``__shard``."""
    depth, held = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for number, (high, found) in enumerate(levels):
        side = found.select(F.col("cell").alias("__cell"), F.col("depth").alias(f"__depth{number}"), F.col("bytes").alias(f"__bytes{number}"))
        rows = rows.withColumn("__cell", F.substring("__bits", 1, high)).join(broadcast_if_small(side), "__cell", "left").drop("__cell")
        depth, held = F.coalesce(depth, F.col(f"__depth{number}")), F.coalesce(held, F.col(f"__bytes{number}"))
    return rows.withColumns({"__depth": depth, "__shard_bytes": held}).withColumn("__shard", F.expr("substring(__bits, 1, __depth)"))


def assign(docs: DataFrame, limit: int = LIMIT_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The shard of every row: ``key, n_bytes, shard, depth, shard_bytes``.

    ``shard`` is the hash prefix of ``depth`` bits; no shard holds more than ``limit`` bytes of
    text, except one that is a single longer row. One row per input row: null keys hash like
    an empty key, null texts have no bytes, and rows that repeat one key are parted by their
    place once the bits of the key are used up. Other columns are left out, so no name can
    clash. An empty table has no shards.
    """
    rows = stored(_hashed(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "key", "text").select("key", "__bytes", "__bits"), "sizes")
    placed = _placed(rows, directory(rows, limit))
    return placed.select(
        F.col("key").alias(key), F.col("__bytes").alias("n_bytes"), F.col("__shard").alias("shard"), F.col("__depth").alias("depth"), F.col("__shard_bytes").alias("shard_bytes")
    )


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES, key: str = "doc_id", text: str = "text") -> None:
    """Write whole rows in one folder ``shard=b<bits>`` per shard, each by one task; a column named ``shard`` is replaced.

    The rows are stored with their hashes first: rows that repeat a key are parted by their place,
    and an input that is read a second time, or by a second attempt, may have other places.
    """
    rows = stored(_hashed(docs.drop("shard"), key, text), "hashed-rows")
    placed = _placed(rows, directory(rows.select("__bytes", "__bits"), limit)).withColumn("shard", F.concat(F.lit("b"), "__shard"))
    placed.select(*[f"`{c}`" for c in docs.columns if c != "shard"], "shard").repartition("shard").write.partitionBy("shard").parquet(path)
