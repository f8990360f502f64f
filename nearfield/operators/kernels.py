"""Small numpy helpers run inside Arrow batches: block distances and a running top-k.

Queries and rows meet in tiles that stay in the processor's cache. A tile is screened with one
single-precision matrix product, or by counted bits; what its error bound cannot rule out is measured
again in double precision, so the outcome is that of a double-precision scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

DECIMALS = 9  # of a score that is shown
_DIGITS = 14  # that decide a rank
_UNIT = 6.0e-8  # rounding unit of float32
_TILE_CELLS = 1 << 21  # distances screened at once
_TILE_ROWS = 4096
_PAIR_CELLS = 1 << 19  # components measured at once in double precision
_FUNCTION_CELLS = 1 << 15  # components given to a function at once
_STEP_ROWS = 1 << 16
_NO_ID = np.iinfo(np.int64).max
_ALL = np.uint64(0x0101010101010101)
CROWD = 4  # candidates per query and k above which a tile is searched for equal rows


@dataclass
class Rows:
    """Base rows as a kernel compares them; rows that are never ranked are left out, ``kept`` are the places of the others."""

    ids: np.ndarray
    kept: np.ndarray
    exact: np.ndarray
    screen: np.ndarray
    size: np.ndarray

    def part(self, places) -> Rows:
        return Rows(self.ids[places], self.kept[places], self.exact[places], self.screen[places], self.size[places])


def _numbers(rows: np.ndarray) -> np.ndarray:
    rows = np.asarray(rows)
    return rows if rows.dtype in (np.float32, np.float64) else rows.astype(np.float64)


def _single(thresholds: np.ndarray) -> np.ndarray:
    """In single precision, never less."""
    with np.errstate(over="ignore"):
        return np.nextafter(thresholds.astype(np.float32), np.float32(np.inf))


class DenseKernel:
    """Distances between double vectors; smaller is nearer (inner products are negated).

    Queries are held as they are stored; what is compared is made from them a tile at a time.
    """

    def __init__(self, metric: str, queries: np.ndarray):
        if metric not in ("l2", "cos", "ip", "dp"):
            raise ValueError(f"not a dense metric: {metric}")
        self.metric = "ip" if metric == "dp" else metric
        self.raw = _numbers(queries)
        with np.errstate(over="ignore", invalid="ignore"):
            square = np.einsum("ij,ij->i", self.raw, self.raw, dtype=np.float64)
        odd = np.flatnonzero(~(np.isfinite(square) & (square > 0)))
        self.known = np.ones(len(self.raw), bool)
        for at in range(0, len(odd), _STEP_ROWS):
            self.known[odd[at : at + _STEP_ROWS]] = ~np.isnan(self.prepare(self.raw[odd[at : at + _STEP_ROWS]])).any(axis=1)

    def prepare(self, rows: np.ndarray) -> np.ndarray:
        rows = np.asarray(rows, dtype=np.float64)
        if self.metric != "cos":
            return rows
        with np.errstate(invalid="ignore", divide="ignore"):
            return rows / np.linalg.norm(rows, axis=1)[:, None]

    def rows(self, ids: np.ndarray, rows: np.ndarray) -> Rows:
        exact = self.prepare(rows)
        kept = np.flatnonzero(~np.isnan(exact).any(axis=1))
        exact = exact[kept]
        return Rows(ids[kept], kept, exact, self._screened(exact), np.linalg.norm(exact, axis=1))

    def _screened(self, exact: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            if self.metric != "l2":
                return exact.astype(np.float32)
            return np.c_[exact, np.einsum("ij,ij->i", exact, exact)].astype(np.float32)

    def tile(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries as they are compared, and their lengths."""
        asked = self.prepare(self.raw[q])
        with np.errstate(over="ignore", invalid="ignore"):
            left = np.c_[-2.0 * asked, np.ones(len(q))] if self.metric == "l2" else -asked
            return left.astype(np.float32), np.linalg.norm(asked, axis=1)

    def approx(self, tile: tuple[np.ndarray, np.ndarray], rows: Rows) -> np.ndarray:
        """Approximate distances (queries x rows) but for what is the same for all rows of a query."""
        with np.errstate(over="ignore", invalid="ignore"):
            return tile[0] @ rows.screen.T

    def error(self, tile: tuple[np.ndarray, np.ndarray], rows: Rows) -> np.ndarray:
        """Bound of the error of each query's approximate distances."""
        length, longest = tile[1], np.nanmax(rows.size, initial=0.0)
        if self.metric == "l2":
            return (rows.exact.shape[1] + 20) * _UNIT * (2.0 * length * longest + longest**2) + 8.0 * _UNIT * (length**2 + longest**2)
        return (rows.exact.shape[1] + 16) * _UNIT * length * longest + 8.0 * _UNIT

    def limit(self, tile: tuple[np.ndarray, np.ndarray], bound: np.ndarray, passed: np.ndarray) -> np.ndarray:
        """A distance bound as the approximate distances are measured."""
        if self.metric == "l2":
            return (bound + 1e-8) ** 2 - tile[1] ** 2
        return bound + 1e-8 - (1.0 if self.metric == "cos" else 0.0)

    def exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        asked = self.prepare(self.raw[q])
        if self.metric == "l2":
            gap = asked - rows
            return np.sqrt(np.einsum("ij,ij->i", gap, gap))
        product = np.einsum("ij,ij->i", asked, rows)
        return 1.0 - product if self.metric == "cos" else -product

    def settled(self, d: np.ndarray) -> np.ndarray:
        """Without the noise of the last digits, so that equal rows tie: relative for l2, whose small values are exact."""
        if self.metric != "l2":
            return np.round(d, _DIGITS) + 0.0
        mantissa, exponent = np.frexp(d)
        return np.ldexp(np.round(mantissa, _DIGITS), exponent)


class BitKernel:
    """Hamming or Jaccard distance between packed words."""

    def __init__(self, metric: str, queries: np.ndarray):
        self.metric = metric
        self.raw = self.prepare(queries)
        self.known = np.ones(len(self.raw), bool)
        self.short = not (self.raw >> np.uint64(32)).any()

    def settled(self, d: np.ndarray) -> np.ndarray:
        return np.round(d, _DIGITS)

    def prepare(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows, dtype=np.int64).view(np.uint64)

    @staticmethod
    def _joined(words: np.ndarray) -> np.ndarray:
        """Two words of at most 32 bits in one."""
        if words.shape[1] % 2:
            words = np.c_[words, np.zeros(len(words), np.uint64)]
        return words[:, ::2] | words[:, 1::2] << np.uint64(32)

    def rows(self, ids: np.ndarray, rows: np.ndarray) -> Rows:
        exact = self.prepare(rows)
        joined = self.short and not (exact >> np.uint64(32)).any()
        screen = self._joined(exact) if joined else exact
        return Rows(ids, np.arange(len(ids)), exact, screen, np.bitwise_count(exact).sum(axis=1, dtype=np.uint16))

    def tile(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        raw = self.raw[q]
        return raw, self._joined(raw) if self.short else None

    def approx(self, tile: tuple[np.ndarray, np.ndarray | None], rows: Rows) -> np.ndarray:
        asked = tile[0] if tile[1] is None or tile[1].shape[1] != rows.screen.shape[1] else tile[1]
        meet = np.bitwise_xor if self.metric == "hamming" else np.bitwise_and
        kind = np.uint8 if asked.shape[1] < 4 else np.uint16
        found = None
        for word in range(asked.shape[1]):
            count = np.bitwise_count(meet(asked[:, word, None], rows.screen[None, :, word]))
            found = count if found is None else np.add(found, count, dtype=kind)
        if found is None:
            found = np.zeros((len(asked), len(rows.ids)), kind)
        if self.metric == "hamming":
            return found
        both = found.astype(np.float32)
        either = np.bitwise_count(tile[0]).sum(axis=1, dtype=np.float32)[:, None] + rows.size.astype(np.float32)[None, :]
        either -= both
        same = either == 0 if not rows.size.all() else None
        with np.errstate(invalid="ignore"):
            both /= either
        np.subtract(np.float32(1), both, out=both)
        if same is not None:
            both[same] = 0.0
        return both

    def error(self, tile: tuple, rows: Rows) -> np.ndarray:
        return np.full(len(tile[0]), 1e-6)

    def limit(self, tile: tuple, bound: np.ndarray, passed: np.ndarray) -> np.ndarray:
        """Whole-number distances that only tie are ruled out where all rows have higher ids than the last that is held."""
        return np.where(passed, bound - 0.5, bound) if self.metric == "hamming" else bound

    def exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        a, b = self.raw[q], rows
        if self.metric == "hamming":
            return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.float64)
        both = np.bitwise_count(a & b).sum(axis=-1, dtype=np.float64)
        either = np.bitwise_count(a | b).sum(axis=-1, dtype=np.float64)
        return np.where(either > 0, 1.0 - both / np.maximum(either, 1.0), 0.0)


class FunctionKernel:
    """A measure given as a numpy function of broadcasting arrays; larger-is-nearer ones are negated.

    ``single`` is the error that each component adds at most where the function is given single
    precision; without it all pairs are screened in double precision.
    """

    def __init__(self, block, sign: int, queries: np.ndarray, single: float | None = None):
        self.block, self.sign, self.single = block, sign, single
        self.raw = _numbers(queries)
        self.known = ~np.isnan(self.raw).any(axis=1)
        self.plain = single is not None and _plain(self.raw)

    def prepare(self, rows: np.ndarray) -> np.ndarray:
        return np.asarray(rows, dtype=np.float64)

    def settled(self, d: np.ndarray) -> np.ndarray:
        mantissa, exponent = np.frexp(d)
        return np.ldexp(np.round(mantissa, _DIGITS), exponent)

    def rows(self, ids: np.ndarray, rows: np.ndarray) -> Rows:
        kept = np.flatnonzero(~np.isnan(rows).any(axis=1))
        exact = self.prepare(rows[kept])
        screen = exact.astype(np.float32) if self.plain and _plain(exact) else exact
        return Rows(ids[kept], kept, exact, screen, np.ones(len(kept)))

    def tile(self, q: np.ndarray) -> np.ndarray:
        return self.raw[q]

    def approx(self, tile: np.ndarray, rows: Rows) -> np.ndarray:
        """Measured in full, so few pairs at a time that they stay in the cache."""
        kind = rows.screen.dtype
        asked, found = tile.astype(kind), np.empty((len(tile), len(rows.ids)), kind)
        wide = max(1, min(len(rows.ids), _FUNCTION_CELLS // max(1, rows.screen.shape[1])))
        step = max(1, _FUNCTION_CELLS // max(1, rows.screen.shape[1] * wide))
        for start in range(0, len(rows.ids), wide):
            part = rows.screen[None, start : start + wide, :]
            for at in range(0, len(asked), step):
                found[at : at + step, start : start + wide] = self.block(asked[at : at + step, None, :], part)
        return found if self.sign == 1 else np.negative(found, out=found)

    def error(self, tile: np.ndarray, rows: Rows) -> np.ndarray:
        return np.full(len(tile), self.single * rows.exact.shape[1] if rows.screen.dtype == np.float32 else 1e-12)

    def limit(self, tile: np.ndarray, bound: np.ndarray, passed: np.ndarray) -> np.ndarray:
        finite = np.isfinite(bound)
        return bound + np.where(finite, 1e-12 * np.abs(bound, where=finite, out=np.zeros(len(bound))), 0.0)

    def exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.sign * np.asarray(self.block(np.asarray(self.raw[q], dtype=np.float64), rows), dtype=np.float64)


def _plain(rows: np.ndarray) -> bool:
    """Whether single precision holds all values, but for their last digits."""
    for at in range(0, len(rows), _STEP_ROWS):
        size = np.abs(rows[at : at + _STEP_ROWS])
        if ((size > 1e30) | (size < 1e-30) & (size > 0)).any():
            return False
    return True


class ProductKernel(DenseKernel):
    """Squared L2 distance from full queries to product codes: to the vector that the codes stand for."""

    def __init__(self, codebooks: np.ndarray, queries: np.ndarray):
        super().__init__("l2", queries)
        self.codebooks = np.asarray(codebooks, dtype=np.float64)

    def settled(self, d: np.ndarray) -> np.ndarray:
        return np.round(d, _DIGITS)

    def rows(self, ids: np.ndarray, rows: np.ndarray) -> Rows:
        codes = np.asarray(rows, dtype=np.int64)
        parts = np.arange(codes.shape[1])
        return super().rows(ids, self.codebooks[parts[None, :], codes].reshape(len(codes), -1))

    def limit(self, tile: tuple[np.ndarray, np.ndarray], bound: np.ndarray, passed: np.ndarray) -> np.ndarray:
        return bound + 1e-8 - tile[1] ** 2

    def exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        gap = (np.asarray(self.raw[q], dtype=np.float64) - rows).reshape(len(q), self.codebooks.shape[0], -1)
        return np.einsum("qmw,qmw->qm", gap, gap).sum(axis=1)


class RunningTopK:
    """The k nearest rows seen so far for each query, ties broken by the lower id.

    With ``fine`` a second measure is kept beside each row; it does not decide what is kept. Rows
    beyond the ``limits`` of their queries are not kept.
    """

    def __init__(self, n_queries: int, k: int, fine: bool = False, limits: np.ndarray | None = None):
        self.k = k
        self.bound = np.full(n_queries, np.inf) if limits is None else limits.copy()
        self.last = np.full(n_queries, _NO_ID)
        self.held = np.zeros(n_queries, dtype=np.int64)
        self._d = np.full((n_queries, k), np.inf)
        self._ids = np.full((n_queries, k), _NO_ID)
        self._fine = np.full((n_queries, k), np.nan) if fine else None

    @property
    def _taken(self) -> np.ndarray:
        return np.arange(self.k)[None, :] < self.held[:, None]

    @property
    def q(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.held)), self.held)

    @property
    def d(self) -> np.ndarray:
        return self._d[self._taken]

    @property
    def ids(self) -> np.ndarray:
        return self._ids[self._taken]

    @property
    def fine(self) -> np.ndarray:
        return self._fine[self._taken]

    def refined(self, cut: int, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the first ``cut`` rows of each query the ``keep`` least by the second measure: queries, ids and that measure."""
        fine = np.where(self._taken, self._fine, np.nan)[:, :cut]
        order = np.lexsort((self._ids[:, :cut], fine), axis=1)[:, :keep]
        fine, ids = np.take_along_axis(fine, order, 1), np.take_along_axis(self._ids, order, 1)
        known = ~np.isnan(fine)
        return np.repeat(np.arange(len(fine)), known.sum(axis=1)), ids[known], fine[known]

    def offer(self, q: np.ndarray, d: np.ndarray, ids: np.ndarray, measure: Callable[[np.ndarray], np.ndarray] | None = None) -> None:
        """Rows for the queries ``q``; ``measure`` gives the second measure of those at some places."""
        at = np.flatnonzero((d < self.bound[q]) | (d == self.bound[q]) & (ids < self.last[q]) | (self.held[q] < self.k) & (d <= self.bound[q]))
        if not len(at) or not self.k:
            return
        if (np.diff(q[at]) < 0).any() or np.bincount(q[at]).max() > 4 * self.k + 32:
            at = at[np.lexsort((ids[at], d[at], q[at]))]
            at = at[_place(q[at]) < self.k]
        q, d, ids, fine = q[at], d[at], ids[at], measure(at) if measure else None
        place = _place(q)
        asked, counts = q[place == 0], np.diff(np.r_[np.flatnonzero(place == 0), len(q)])
        row, place = np.repeat(np.arange(len(asked)), counts), place + self.k

        def beside(held: np.ndarray, more: np.ndarray, empty) -> np.ndarray:
            out = np.full((len(asked), self.k + int(counts.max())), empty, dtype=held.dtype)
            out[:, : self.k] = held[asked]
            out[row, place] = more
            return out

        all_d, all_ids = beside(self._d, d, np.inf), beside(self._ids, ids, _NO_ID)
        order = np.lexsort((all_ids, all_d), axis=1)[:, : self.k]
        self._d[asked], self._ids[asked] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_ids, order, 1)
        if fine is not None:
            self._fine[asked] = np.take_along_axis(beside(self._fine, fine, np.nan), order, 1)
        self.held[asked] = np.minimum(self.k, self.held[asked] + counts)
        full = asked[self.held[asked] == self.k]
        self.bound[full], self.last[full] = self._d[full, -1], self._ids[full, -1]


def _place(groups: np.ndarray) -> np.ndarray:
    """Place of each row in its run of equal values."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.empty(0, np.int64)
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))


def thin_copies(ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal rows keep the k lowest ids: no other copy can be among the k nearest."""
    kept = _first_copies(ids, rows, k)
    return ids[kept], rows[kept]


def _first_copies(ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that ``thin_copies`` keeps, by id."""
    order = np.argsort(ids, kind="stable")
    rows = np.ascontiguousarray(rows[order])
    _, group = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * rows.itemsize))).ravel(), return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    ordered = group[by_group]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    place = np.arange(len(ordered)) - np.repeat(starts, np.diff(np.r_[starts, len(ordered)]))
    return order[by_group[place < k]]


def _left(over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Query and row of the cells that are not ruled out, which are few: eight are looked at together."""
    flat = over.ravel()
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64) != _ALL)
    cells = (words[:, None] * 8 + np.arange(8)).ravel()
    cells = np.r_[cells[~flat[cells]], whole + np.flatnonzero(~flat[whole:])]
    return np.divmod(cells, over.shape[1])


def _candidates(kernel, tile, state: RunningTopK, q: np.ndarray, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Pairs the screening cannot rule out."""
    approx, error = kernel.approx(tile, rows), kernel.error(tile, rows)
    bound = state.bound[q]
    cut = kernel.limit(tile, bound, state.last[q] < rows.ids.min()) + error
    unlimited = np.flatnonzero(np.isinf(bound))
    if len(rows.ids) > state.k and len(unlimited):
        kth = np.partition(approx if len(unlimited) == len(q) else approx[unlimited], state.k - 1, axis=1)[:, state.k - 1]
        cut[unlimited] = kth + 2.0 * error[unlimited] + 1e-8
    if approx.dtype.kind == "u":
        top = np.iinfo(approx.dtype).max
        cut = np.floor(np.clip(cut, 0, top)).astype(approx.dtype)
    else:
        cut = _single(cut) if approx.dtype == np.float32 else cut
    with np.errstate(invalid="ignore"):
        return _left(approx > cut[:, None])


def scan_block(kernel, state: RunningTopK, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, fine: tuple | None = None) -> None:
    """Offer every row of a block to the queries ``q``. ``fine`` is a second kernel and its rows, for the second measure."""
    rows, q = kernel.rows(ids, rows), q[kernel.known[q]]
    if not len(rows.ids) or not len(q) or not state.k:
        return
    wide = min(len(rows.ids), _TILE_ROWS)
    tall = max(16, _TILE_CELLS // wide)
    parts = [rows.part(slice(at, at + wide)) for at in range(0, len(rows.ids), wide)]
    pair_step = max(256, _PAIR_CELLS // max(1, rows.exact.shape[1]))
    if fine is not None:
        second, exact = fine[0], fine[0].prepare(fine[1])
    for start in range(0, len(q), tall):
        asked = q[start : start + tall]
        tile = kernel.tile(asked)
        for part in parts:
            qi, ri = _candidates(kernel, tile, state, asked, part)
            if len(qi) > CROWD * state.k * len(asked) and len(part.ids) > state.k:
                part = part.part(_first_copies(part.ids, part.exact, state.k))
                qi, ri = _candidates(kernel, tile, state, asked, part)
            for at in range(0, len(qi), pair_step):
                pq, pr = asked[qi[at : at + pair_step]], ri[at : at + pair_step]
                d = kernel.settled(kernel.exact(pq, part.exact[pr]))
                if not (known := ~np.isnan(d)).all():
                    pq, pr, d = pq[known], pr[known], d[known]
                measure = None
                if fine is not None:
                    place = part.kept[pr]
                    measure = lambda at, pq=pq, place=place: second.settled(second.exact(pq[at], exact[place[at]]))
                state.offer(pq, d, part.ids[pr], measure)


def nearest_points(points: np.ndarray, rows: np.ndarray, k: int = 1, metric: str = "l2") -> np.ndarray:
    """Indexes of the k nearest points (lower index on ties) of every row, nearest first."""
    k = min(k, len(points))
    found = np.empty((len(rows), k), np.int64)
    step = max(256, _TILE_CELLS // max(1, k))
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        best = RunningTopK(len(part), k)
        scan_block(DenseKernel(metric, part), best, np.arange(len(part)), np.arange(len(points)), points)
        found[at : at + step] = best.ids.reshape(len(part), k)
    return found
