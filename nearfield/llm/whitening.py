"""Whitening of embeddings by an incremental eigendecomposition.

Every task keeps the spectrum of what it has read: count, mean, and the eigenvalues and
eigenvectors of the scatter about that mean. A vector enters as a centred rank-one update. The new
eigenvalues are the roots of a secular equation, found between the old ones; directions that the
update leaves alone are deflated, and the eigenvectors come from a vector recomputed so that the
roots are exact for it, which keeps them orthogonal. The spectra of tasks are joined in a tree by
the same rank-one updates, one for each direction and one for the gap of the means. A last
Rayleigh-Ritz step over all rows in the basis so found gives the result its full precision.

Rows of a block are first rotated onto at most as many rows as there are dimensions, with the same
scatter; those are the updates. With ``block_rows=1`` every row is one by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import stored
from nearfield.operators.nearest import matrix

COMPONENTS = 32
BLOCK_ROWS = 4096
FAN_IN = 32
_EPS = np.finfo(np.float64).eps


@dataclass(frozen=True)
class Grid:
    """Whole numbers ``floor(scale * c) + offset`` in the place of entries, so that sums are exact in any order."""

    scale: int = 64
    offset: int = 1_000_000

    def steps(self, rows: np.ndarray) -> np.ndarray:
        """Steps from the offset, as whole numbers."""
        out = np.floor(self.scale * rows)
        if out.size and np.abs(out).max() >= 2.0**62:
            raise OverflowError("an entry is too large for the grid")
        return out.astype(np.int64)


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``diag(d) + z z'`` for ascending distinct ``d`` and ``z`` without zeros.

    Each root is given as the index of its nearest pole and its distance from that, which stays
    accurate where root and pole agree to the last digit. All roots are sought at once: both
    neighbouring poles are kept in a rational approximation, an interval guards each step.
    """
    k, z2 = len(d), z * z
    right = np.r_[d[1:], d[-1] + z2.sum()]
    half = (right - d) / 2
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        middle = 1.0 + (z2 / ((d[None, :] - d[:, None]) - half[:, None])).sum(1)
        origin = np.arange(k) + ((middle < 0) & (np.arange(k) < k - 1))
        delta = d[None, :] - d[origin][:, None]  # poles as seen from the origin of each root
        near = origin == np.arange(k)
        last = np.arange(k) == k - 1
        low, high = np.where(near, 0.0, -half), np.where(near, half, 0.0)
        low[-1], high[-1] = (half[-1], 2 * half[-1]) if middle[-1] < 0 else (0.0, half[-1])
        y = (low + high) / 2
        left_pole, right_pole = d - d[origin], right - d[origin]
        left_of = np.tri(k, dtype=bool)  # poles up to the root's own
        for _ in range(80):
            gap = delta - y[:, None]
            term = z2 / gap
            slope = term / gap
            w = 1.0 + term.sum(1)
            done = np.abs(w) <= 4 * _EPS * k * (1.0 + np.abs(term).sum(1))
            narrow = high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high))
            if (done | narrow).all():
                break
            low, high = np.where(w < 0, y, low), np.where(w > 0, y, high)
            psi = np.where(left_of, slope, 0.0).sum(1)
            phi = slope.sum(1) - psi
            a_, b_ = left_pole - y, right_pole - y
            c = w - a_ * psi - b_ * phi
            a = (a_ + b_) * w - a_ * b_ * (psi + phi)
            b = a_ * b_ * w
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            alone = a_ * a_ * psi / (w - a_ * psi) + a_  # of the last root, which has no pole on its right
            step = np.where(last, alone, step)
            new = np.where(done, y, y + step)
            out = ~((new > low) & (new < high)) & ~done
            y = np.where(out, (low + high) / 2, new)
    return origin, y


def rank_one(values: np.ndarray, basis: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``basis diag(values) basis' + v v'``; what of ``v`` lies outside the basis becomes a direction of its own."""
    z = basis.T @ v
    rest = v - basis @ z
    again = basis.T @ rest
    z, rest = z + again, rest - basis @ again
    length, size = np.linalg.norm(rest), np.linalg.norm(v)
    if basis.shape[1] < len(v) and length > 16 * _EPS * len(v) * size:
        values, basis, z = np.r_[values, 0.0], np.column_stack((basis, rest / length)), np.r_[z, length]
    order = np.argsort(values, kind="stable")
    d, basis, z = values[order], basis[:, order], z[order]
    tol = 8 * _EPS * max(d[-1] if len(d) else 0.0, size * size)
    active = np.abs(z) * size > tol
    # Two poles that agree to rounding are turned so that one of them is left alone.
    picked = np.flatnonzero(active)
    if len(picked) > 1 and (np.diff(d[picked]) <= tol * 4).any():
        basis, d = basis.copy(), d.copy()
        before = picked[0]
        for i in picked[1:]:
            r = np.hypot(z[before], z[i])
            c, s = z[i] / r, z[before] / r
            if abs(c * s * (d[i] - d[before])) <= tol:
                turned = c * basis[:, before] - s * basis[:, i], s * basis[:, before] + c * basis[:, i]
                basis[:, before], basis[:, i] = turned
                z[before], z[i], active[before] = 0.0, r, False
                d[before], d[i] = c * c * d[before] + s * s * d[i], s * s * d[before] + c * c * d[i]
            before = i
    picked = np.flatnonzero(active)
    if not len(picked):
        return d, basis
    picked = picked[np.argsort(d[picked], kind="stable")]
    poles, zs = d[picked], z[picked]
    origin, y = secular_roots(poles, zs)
    away = y[:, None] - (poles[None, :] - poles[origin][:, None])  # root j minus pole i
    ratio = away.copy()
    k = len(poles)
    gaps = poles[None, :] - poles[:, None]  # pole i minus pole j, for row j
    below = np.tri(k, k, -1, dtype=bool).T  # j < i
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio[below] /= -gaps[below]
        upper = np.zeros((k, k))
        upper[:-1] = poles[1:, None] - poles[None, :]  # the pole after root j, minus pole i
        rest_ = ~below
        rest_[-1] = False
        ratio[rest_] /= upper[rest_]
    exact = np.sqrt(np.abs(np.prod(ratio, axis=0))) * np.sign(zs)
    turn = exact[None, :] / -away
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    values, vectors = d.copy(), basis.copy()
    values[picked] = poles[origin] + y
    vectors[:, picked] = basis[:, picked] @ turn.T
    return values, vectors


@dataclass
class Spectrum:
    """Count, mean, and eigenvalues and eigenvectors of the scatter about the mean."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim), np.empty(0), np.empty((dim, 0)))

    def update(self, v: np.ndarray) -> None:
        if v.any():
            self.values, self.basis = rank_one(self.values, self.basis, v)

    def _shift(self, n: int, mean: np.ndarray) -> None:
        gap = mean - self.mean
        self.update(np.sqrt(self.n * n / (self.n + n)) * gap)
        self.n += n
        self.mean = self.mean + gap * (n / self.n)

    def absorb(self, rows: np.ndarray) -> None:
        """Rows as centred rank-one updates, after a rotation onto at most as many rows as dimensions."""
        mean = rows.mean(axis=0)
        if len(rows) > 1:
            for v in np.linalg.qr(rows - mean, mode="r"):
                self.update(v)
        self._shift(len(rows), mean)

    def join(self, other: Spectrum) -> None:
        if len(other.mean) != len(self.mean):
            raise ValueError(f"vectors have {len(other.mean)} components, others have {len(self.mean)}")
        for value, direction in zip(other.values, other.basis.T):
            self.update(np.sqrt(max(value, 0.0)) * direction)
        self._shift(other.n, other.mean)


@dataclass(frozen=True)
class Whitening:
    """``n`` fitted vectors with sums ``total`` (whole steps on a grid), and their leading components, one to a row."""

    n: int
    total: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    grid: Grid | None

    def mean(self) -> np.ndarray:
        return self.total / self.n

    def parts(self) -> tuple:
        """Plain values to broadcast."""
        return self.n, self.total, self.components, self.values, self.mean()


def _rows(batch: pa.RecordBatch, grid: Grid | None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a batch have whole, finite vectors, and those vectors as doubles or grid steps."""
    column = batch.column("emb")
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    known = sizes > 0
    if len(known) and not np.isfinite(flat).all():
        owner = np.repeat(np.arange(len(sizes)), sizes)
        known[owner[~np.isfinite(flat)]] = False
    kept = np.flatnonzero(known)
    rows = matrix(column.take(pa.array(kept))).astype(np.float64)
    return kept, grid.steps(rows) if grid else rows


_BYTES = "part INT, dim INT, n BIGINT, total BINARY, mean BINARY, vals BINARY, basis BINARY"


def _packed(part: int, total: np.ndarray, s: Spectrum) -> tuple:
    return part, len(s.mean), s.n, total.tobytes(), s.mean.tobytes(), s.values.tobytes(), s.basis.tobytes()


def _unpacked(row, kind) -> tuple[np.ndarray, Spectrum]:
    mean = np.frombuffer(row.mean)
    return np.frombuffer(row.total, kind), Spectrum(int(row.n), mean, np.frombuffer(row.vals), np.frombuffer(row.basis).reshape(len(mean), -1))


def _tree(parts: DataFrame, merge: Callable[[pd.DataFrame], pd.DataFrame], name: str):
    """Join the rows of all tasks, up to ``FAN_IN`` in one, until one row is left; the driver gets that row or None."""
    level = stored(parts, name)
    while True:
        joined = level.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int")).groupBy("part").applyInPandas(merge, parts.schema)
        level = stored(joined, name)
        if level.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] == 0:
            return level.first()


def _spectra(docs: DataFrame, grid: Grid | None, block_rows: int):
    kind = np.int64 if grid else np.float64

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = spectrum = None
        for batch in batches:
            rows = _rows(batch, grid)[1]
            for start in range(0, len(rows), block_rows):
                block = rows[start : start + block_rows]
                if spectrum is None:
                    total, spectrum = np.zeros(block.shape[1], kind), Spectrum.empty(block.shape[1])
                if block.shape[1] != len(total):
                    raise ValueError(f"vectors have {block.shape[1]} components, others have {len(total)}")
                total += block.sum(axis=0)
                spectrum.absorb(block.astype(np.float64))
        if spectrum is not None:
            row = _packed(TaskContext.get().partitionId(), total, spectrum)
            yield pa.RecordBatch.from_pylist([dict(zip(["part", "dim", "n", "total", "mean", "vals", "basis"], row))], schema=schema)

    schema = pa.schema([("part", pa.int32()), ("dim", pa.int32()), ("n", pa.int64()), *[(c, pa.binary()) for c in ("total", "mean", "vals", "basis")]])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = spectrum = None
        for row in frame.sort_values(["n", "total", "basis"]).itertuples():  # one order, however the rows come
            more, other = _unpacked(row, kind)
            if spectrum is None:
                total, spectrum = more.copy(), other
            else:
                spectrum.join(other)
                total += more
        return pd.DataFrame([_packed(int(frame["part"].iloc[0]), total, spectrum)], columns=frame.columns)

    return _tree(docs.select("emb").mapInArrow(read, _BYTES), merge, "spectra")


def _products(docs: DataFrame, grid: Grid | None, turned: Callable[[np.ndarray], np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the turned rows and of their products, over all rows."""
    schema = pa.schema([("part", pa.int32()), ("sums", pa.binary()), ("products", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products, any_ = np.zeros(width), np.zeros((width, width)), False
        for batch in batches:
            rows = _rows(batch, grid)[1]
            if len(rows):
                y = turned(rows)
                sums, products, any_ = sums + y.sum(axis=0), products + y.T @ y, True
        if any_:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "sums": sums.tobytes(), "products": products.tobytes()}], schema=schema)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        added = {c: np.sum([np.frombuffer(raw) for raw in sorted(frame[c])], axis=0).tobytes() for c in ("sums", "products")}
        return pd.DataFrame([{"part": int(frame["part"].iloc[0]), **added}], columns=frame.columns)

    row = _tree(docs.select("emb").mapInArrow(read, "part INT, sums BINARY, products BINARY"), merge, "products")
    return np.frombuffer(row["sums"]), np.frombuffer(row["products"]).reshape(width, width)


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("emb")).where("emb IS NOT NULL")


def fit(vectors: DataFrame, components: int = COMPONENTS, grid: Grid | None = None, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> Whitening | None:
    """Leading components of the covariance (divisor n) of all whole, finite vectors; None if there is no such vector.

    Vectors that are null or empty, or hold a null or non-finite entry, take no part; repeated rows
    each count. Vectors of different length are an error. Components without variance are left out,
    so there may be fewer than asked. The driver holds one spectrum, its size set by the dimension.
    """
    rows = _vectors(vectors, key, vector)
    found = _spectra(rows, grid, block_rows)
    if found is None:
        return None
    total, spectrum = _unpacked(found, np.int64 if grid else np.float64)
    n, mean, basis = spectrum.n, total / spectrum.n, np.linalg.qr(spectrum.basis)[0]
    if not basis.shape[1]:
        return Whitening(n, total, np.empty((0, len(total))), np.empty(0), 0.0, grid)
    _, products = _products(rows, grid, lambda x: (x - mean) @ basis, basis.shape[1])
    values, turn = np.linalg.eigh(products / n)
    values, turn = values[::-1], turn[:, ::-1]
    trace = float(values.sum())
    k = min(components, int((values > 64 * _EPS * len(total) * max(trace, 0.0)).sum()))
    return Whitening(n, total, (basis @ turn[:, :k]).T.copy(), values[:k].copy(), trace, grid)


def transform(vectors: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, deviation, whitened``: the whitened vector of every row that took part in a fit, rows repeated included.

    ``deviation`` is the exact squared length of n times the vector less the sums, on a grid; null
    without a grid. A key may be null. Other columns are left out, so no name can clash.
    """
    shared, grid = vectors.sparkSession.sparkContext.broadcast(model.parts()), model.grid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, components, values, mean = shared.value
        for batch in batches:
            kept, rows = _rows(batch, grid)
            if not len(kept):
                continue
            gap, deviation = rows - mean, pa.nulls(len(rows), pa.int64())
            if grid:
                if (n * np.abs(gap) + 1).max() ** 2 * len(total) >= 2.0**63:
                    raise OverflowError("a deviation needs more than 64 bits")
                whole = n * rows - total
                deviation = pa.array(np.einsum("ij,ij->i", whole, whole))
            white = gap @ components.T / np.sqrt(values)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(values)), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(kept)), deviation, lists], ["key", "deviation", "whitened"])

    rows = _vectors(vectors, key, vector)
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, deviation BIGINT, whitened ARRAY<DOUBLE>").withColumnRenamed("key", key)


def identity_error(vectors: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened vectors less the identity, measured over all rows; 0 without components."""
    if not len(model.values):
        return 0.0
    mean, components, scale = model.mean(), model.components, np.sqrt(model.values)
    sums, products = _products(_vectors(vectors, key, vector), model.grid, lambda x: (x - mean) @ components.T / scale, len(scale))
    center = sums / model.n
    return float(np.abs(products / model.n - np.outer(center, center) - np.eye(len(scale))).max())
