"""Rows of a wide table for the ids that a search has found, without moving the wide table.

Few hits are broadcast. More of them, up to a measured size, are packed into sorted arrays that
every task looks its ids up in, so that the wide rows stay where they are read. Beyond that a Bloom
filter of the hit ids, made by the tasks that hold them, stands right above the scan: what leaves
it is about as many rows as there are hits, and only those are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield import sizing
from nearfield.sizing import settle

PACKED_BYTES = 256 * 1024 * 1024
FILTER_BITS = 1 << 31
BITS_PER_ID = 12
PROBES = 6
SEGMENT_BITS = 1 << 20  # of the filter, made by one group each


def attach(wide: DataFrame, hits: DataFrame, max_hits: int, key: str = "id", row_bytes: int = 64, packed_bytes: int | None = None) -> DataFrame:
    """The inner join of a wide table with hits on ``key``: the columns of ``wide``, then the other columns of ``hits``.

    ``max_hits`` bounds the rows of ``hits``, which decides whether they may be broadcast. Repeated
    keys on either side meet as in any join; null keys meet nothing.
    """
    if max_hits <= sizing.MAX_BROADCAST_ROWS and max_hits * row_bytes <= sizing.MAX_BROADCAST_BYTES:
        return wide.join(F.broadcast(hits), key)
    known = settle(hits.where(F.col(key).isNotNull()))
    limit = PACKED_BYTES if packed_bytes is None else packed_bytes
    whole = all(isinstance(df.schema[key].dataType, T.IntegralType) for df in (wide, hits))
    if whole and sizing.is_small(known, max_rows=limit // 8, max_bytes=limit):
        return _looked_up(wide, known, key)
    maybe = id_filter(known, key)
    return wide.where(maybe.holds(F.col(key))).join(known, key)


def _looked_up(wide: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """The join by look-up in the packed hits: no row of the wide table is shuffled."""
    table = hits.toArrow().combine_chunks()
    ids = table[key].to_numpy().astype(np.int64)
    order = np.argsort(ids, kind="stable")
    names, starts = np.unique(ids[order], return_index=True)
    others = [c for c in hits.columns if c != key]
    rest = table.select(others).take(pa.array(order))
    packed = pa.StructArray.from_arrays([rest[c].combine_chunks() for c in others], names=others) if others else pa.nulls(len(order))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("hit", packed.type)])) as writer:
        writer.write_batch(pa.record_batch([packed], names=["hit"]))
    shared = wide.sparkSession.sparkContext.broadcast((names, np.r_[starts, len(order)], sink.getvalue().to_pybytes()))
    kind = T.ArrayType(T.StructType([hits.schema[c] for c in others]))

    @F.arrow_udf(kind)
    def found(column: pa.Array) -> pa.Array:
        names, bounds, raw = shared.value
        hit = pa.ipc.open_stream(raw).read_all()["hit"].combine_chunks()
        asked = column.fill_null(0).to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(names, asked), max(len(names) - 1, 0))
        mine = (names[at] == asked) & column.is_valid().to_numpy(zero_copy_only=False) if len(names) else np.zeros(len(asked), bool)
        size = np.where(mine, np.diff(bounds)[at], 0) if len(names) else np.zeros(len(asked), np.int64)
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[at] - (ends - size), size)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), hit.take(pa.array(place)))

    met = wide.withColumn("_hits", found.asNondeterministic()(F.col(key))).withColumn("_hit", F.explode("_hits"))
    return met.select(*[F.col(f"`{c}`") for c in [key, *[c for c in wide.columns if c != key]]], *[F.col("_hit")[c].alias(c) for c in others])


@dataclass(frozen=True)
class IdFilter:
    """A Bloom filter on the executors: it holds every id it was made from, and few others."""

    bits: Broadcast
    size: int

    def holds(self, key: Column) -> Column:
        shared, size = self.bits, self.size

        @F.arrow_udf("boolean")
        def maybe(hashes: pa.Array) -> pa.Array:
            bits = shared.value
            out = np.ones(len(hashes), bool)
            for place in _places(hashes.to_numpy().view(np.uint64), size):
                out &= (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
            return pa.array(out)

        return key.isNotNull() & maybe(F.xxhash64(key.cast("string")))


def _places(hashes: np.ndarray, size: int):
    """Bits of an id, all in one segment, which the high bits of its hash name."""
    segments = max(1, size // SEGMENT_BITS)
    start = (hashes >> np.uint64(40)).astype(np.int64) % segments * SEGMENT_BITS
    first, step = hashes & np.uint64(0xFFFFF), (hashes >> np.uint64(20)) & np.uint64(0xFFFFF) | np.uint64(1)
    for i in range(PROBES):
        yield start + ((first + np.uint64(i) * step) % np.uint64(SEGMENT_BITS)).astype(np.int64)


def id_filter(hits: DataFrame, key: str = "id") -> IdFilter:
    """A filter of ``BITS_PER_ID`` bits for each different id, of at most ``FILTER_BITS``; its segments are made side by side."""
    hashes = hits.where(F.col(key).isNotNull()).select(F.xxhash64(F.col(key).cast("string")).alias("h")).distinct()
    wanted = max(1, hashes.count()) * BITS_PER_ID
    size = min(FILTER_BITS, SEGMENT_BITS << max(0, int(-(-wanted // SEGMENT_BITS) - 1).bit_length()))
    segments = size // SEGMENT_BITS

    def make(table: pa.Table) -> pa.Table:
        mine, number = np.zeros(SEGMENT_BITS, bool), table["segment"][0].as_py()
        for place in _places(table["h"].to_numpy().view(np.uint64), size):
            mine[place - number * SEGMENT_BITS] = True
        return pa.table({"segment": pa.array([number], pa.int64()), "bits": pa.array([np.packbits(mine, bitorder="little").tobytes()], pa.binary())})

    placed = hashes.withColumn("segment", F.shiftrightunsigned("h", 40) % segments)
    made = placed.groupBy("segment").applyInArrow(make, "segment BIGINT, bits BINARY").toArrow()
    bits = np.zeros(size // 8, np.uint8)
    for number, raw in zip(made["segment"].to_pylist(), made["bits"].to_pylist()):
        bits[number * SEGMENT_BITS // 8 : (number + 1) * SEGMENT_BITS // 8] = np.frombuffer(raw, np.uint8)
    return IdFilter(hits.sparkSession.sparkContext.broadcast(bits), size)
