"""Scalar, product and reduced-precision codes, computed in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.operators.kernels import nearest_points
from nearfield.operators.lloyd import train_codes
from nearfield.operators.nearest import matrix

# Number of steps of each scalar code.
SCALAR_STEPS = {"SQ8": 255, "SQ6": 63, "SQ4U": 15}


def dimension_ranges(base: DataFrame) -> DataFrame:
    """Smallest and largest value of each dimension: ``dim, lo, hi``.

    Each task sends one row per dimension to the shuffle.
    """

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo = hi = None
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column(0)).astype(np.float64)
                low, high = rows.min(axis=0), rows.max(axis=0)
                lo = low if lo is None else np.minimum(lo, low)
                hi = high if hi is None else np.maximum(hi, high)
        if lo is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(lo), dtype=np.int32)), pa.array(lo), pa.array(hi)], names=["dim", "lo", "hi"]
            )

    local = base.where(F.col("emb").isNotNull()).select("emb").mapInArrow(extremes, "dim INT, lo DOUBLE, hi DOUBLE")
    return local.groupBy("dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@dataclass(frozen=True)
class ScalarCodec:
    """Per-dimension linear codes; ``SQ4U`` uses one range for all dimensions."""

    lo: np.ndarray
    hi: np.ndarray
    steps: int

    @classmethod
    def fit(cls, base: DataFrame, kind: str = "SQ8") -> ScalarCodec:
        """Learn the ranges; only one row per dimension reaches the driver."""
        ranges = dimension_ranges(base).orderBy("dim").toArrow()
        lo, hi = ranges["lo"].to_numpy(), ranges["hi"].to_numpy()
        if kind == "SQ4U" and len(lo):
            lo, hi = np.full_like(lo, lo.min()), np.full_like(hi, hi.max())
        return cls(lo, hi, SCALAR_STEPS[kind])

    def encode(self, v: Column) -> Column:
        lo, width, steps = self.lo, np.where(self.hi > self.lo, self.hi - self.lo, 1.0), self.steps

        @F.arrow_udf("array<smallint>")
        def codes(vectors: pa.Array) -> pa.Array:
            raw = np.floor((_filled(vectors, len(lo)) - lo) / width * steps + 0.5)
            return _lists(vectors, np.clip(raw, 0, steps).astype(np.int16))

        return codes(v)

    def decode(self, v: Column) -> Column:
        lo, width, steps = self.lo, np.where(self.hi > self.lo, self.hi - self.lo, 1.0), self.steps

        @F.arrow_udf("array<double>")
        def values(codes: pa.Array) -> pa.Array:
            return _lists(codes, lo + _filled(codes, len(lo)) * width / steps)

        return values(v)


def _filled(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as double rows, zero where the row is null."""
    out = np.zeros((len(column), dim))
    present = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if len(present):
        out[present] = matrix(column.drop_null())
    return out


def _lists(like: pa.Array, rows: np.ndarray) -> pa.Array:
    """Rows as an Arrow list column with the nulls of ``like``."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] if rows.ndim == 2 else 0)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))
    missing = like.is_null()
    if not missing.true_count:
        return lists
    return pa.ListArray.from_arrays(
        pa.array(offsets, mask=np.r_[missing.to_numpy(zero_copy_only=False), False]), pa.array(rows.reshape(-1))
    )


def reduce_precision(v: Column, kind: str = "FP16") -> Column:
    """Values rounded to half precision (``FP16``) or cut to bfloat16 (``BF16``), as float."""
    if kind not in ("FP16", "BF16"):
        raise ValueError(f"unsupported precision: {kind}")

    @F.arrow_udf("array<float>")
    def rounded(vectors: pa.Array) -> pa.Array:
        flat = np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float32)
        if kind == "FP16":
            with np.errstate(over="ignore"):
                flat = flat.astype(np.float16).astype(np.float32)
        else:
            flat = (flat.view(np.uint32) & np.uint32(0xFFFF0000)).view(np.float32)
        lengths = np.diff(np.r_[0, np.cumsum(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
        gone = vectors.is_null().to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(offsets, mask=np.r_[gone, False]), pa.array(flat))

    return rounded(v)


def train_centroids(base: DataFrame, n_lists: int, seed: int = 0, max_iter: int = 10) -> np.ndarray:
    """K-means centres of the vectors; only the centres reach the driver."""
    vectors = base.where(F.col("emb").isNotNull()).select(
        array_to_vector(F.col("emb").cast("array<double>")).alias("features")
    )
    model = KMeans(k=n_lists, seed=seed, maxIter=max_iter, initMode="k-means||").fit(vectors)
    return np.stack(model.clusterCenters())


def first_vectors(base: DataFrame, n: int) -> np.ndarray:
    """The vectors of the n lowest ids, usable as given centres or codebooks."""
    rows = base.where(F.col("emb").isNotNull()).orderBy("id").limit(n).select("emb").toArrow()
    return matrix(rows["emb"]).astype(np.float64)


def nearest_index(v: Column, points: np.ndarray, metric: str = "l2") -> Column:
    """Index of the nearest of a bounded set of points for each vector."""

    @F.arrow_udf("int")
    def index(vectors: pa.Array) -> pa.Array:
        rows = _filled(vectors, points.shape[1])
        found = nearest_points(points, rows, 1, metric)[:, 0] if len(rows) else np.empty(0)
        return pa.array(found.astype(np.int32), mask=vectors.is_null().to_numpy(zero_copy_only=False))

    # Marked so that a filter on the index does not compute it twice.
    return index.asNondeterministic()(v)


def nearest_indexes(v: Column, points: np.ndarray, k: int, metric: str = "l2", once: bool = False) -> Column:
    """Indexes of the k nearest of a bounded set of points for each vector, nearest first. ``once``: before any filter on the result."""

    @F.arrow_udf("array<int>")
    def indexes(vectors: pa.Array) -> pa.Array:
        rows = _filled(vectors, points.shape[1])
        found = nearest_points(points, rows, k, metric) if len(rows) else np.empty((0, k))
        return _lists(vectors, found.astype(np.int32))

    return (indexes.asNondeterministic() if once else indexes)(v)


@dataclass(frozen=True)
class ProductCodec:
    """Product codes: ``codebooks`` has shape (parts, codes, dims per part)."""

    codebooks: np.ndarray

    @classmethod
    def given(cls, vectors: np.ndarray, parts: int) -> ProductCodec:
        """Codebooks cut out of whole vectors, one code per vector."""
        return cls(vectors.reshape(len(vectors), parts, -1).transpose(1, 0, 2).copy())

    @classmethod
    def train(cls, base: DataFrame, parts: int, bits: int = 8, seed: int = 0) -> ProductCodec:
        """Codebook of 2^bits codes per part; every iteration serves all parts."""
        return cls(train_codes(base, parts, 2**bits, seed))

    def encode(self, v: Column) -> Column:
        books = self.codebooks

        @F.arrow_udf("array<smallint>")
        def codes(vectors: pa.Array) -> pa.Array:
            parts, _, width = books.shape
            rows = _filled(vectors, parts * width)
            out = np.empty((len(rows), parts), dtype=np.int16)
            for part in range(parts):
                if len(rows):
                    out[:, part] = nearest_points(books[part], rows[:, part * width : (part + 1) * width])[:, 0]
            return _lists(vectors, out)

        return codes(v)
