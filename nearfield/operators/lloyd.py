"""Centres for lists and codebooks for product codes, trained over the whole table.

One iteration serves all parts of the vectors at once: every task assigns its rows to the nearest
code of each part and sends one row of sums per part and code, which are added up by key. The
driver holds the codebooks and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.nearest import matrix

SEED_BUCKETS = 4  # vectors to choose each starting code from
SPREAD_CODES = 4096  # up to so many codes the starts are spread out by distance
GAIN = 1e-4  # relative gain below which iterations end
_CELLS = 1 << 22


def _sum_columns(rows: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of each group, and their numbers."""
    order = np.argsort(group, kind="stable")
    counts = np.bincount(group, minlength=n)
    out = np.zeros((n, rows.shape[1]))
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(rows[order], (np.cumsum(counts) - counts)[full], axis=0)
    return out, counts


def _candidates(base: DataFrame, buckets: int) -> np.ndarray:
    """At most one vector of each hash bucket, that with the least hash: different vectors, however often one repeats."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list]] = {}
        for batch in batches:
            hashes = batch.column(0).to_numpy()
            order = np.argsort(hashes, kind="stable")
            _, first = np.unique(hashes[order] % buckets, return_index=True)
            for row in order[first].tolist():
                h = int(hashes[row])
                if h % buckets not in held or h < held[h % buckets][0]:
                    held[h % buckets] = (h, batch.column(1)[row].as_py())
        if held:
            yield pa.RecordBatch.from_pydict({"bucket": list(held), "h": [h for h, _ in held.values()], "emb": [e for _, e in held.values()]}, schema=schema)

    schema = pa.schema([("bucket", pa.int64()), ("h", pa.int64()), ("emb", pa.list_(pa.float64()))])
    hashed = base.select(F.xxhash64("emb").alias("h"), F.col("emb").cast("array<double>").alias("emb"))
    local = hashed.mapInArrow(least, "bucket BIGINT, h BIGINT, emb ARRAY<DOUBLE>")
    found = local.groupBy("bucket").agg(F.min_by("emb", "h").alias("emb")).orderBy("bucket").select("emb").toArrow()
    return matrix(found["emb"]).astype(np.float64)


def _starts(points: np.ndarray, codes: int, rng: np.random.Generator) -> np.ndarray:
    """Starting codes out of the points, each the best of a few that are drawn by distance; the last is repeated where there are too few."""
    if len(points) > codes and codes <= SPREAD_CODES:
        norms = np.einsum("ij,ij->i", points, points)
        chosen = [int(rng.integers(len(points)))]
        gap = np.maximum(norms + norms[chosen[0]] - 2.0 * (points @ points[chosen[0]]), 0.0)
        tries = 2 + int(np.log(codes))
        while len(chosen) < codes:
            total = gap.sum()
            drawn = rng.choice(len(points), tries, p=gap / total) if total > 0 else np.full(1, chosen[-1])
            after = np.minimum(gap[:, None], norms[:, None] + norms[drawn] - 2.0 * (points @ points[drawn].T))
            best = int(after.sum(axis=0).argmin())
            chosen.append(int(drawn[best]))
            gap = np.maximum(after[:, best], 0.0)
        return points[chosen]
    return points[np.minimum(np.arange(codes), len(points) - 1)]


def _assign(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest code of each row (the lower number on ties) and the squared distance."""
    code, loss = np.empty(len(rows), np.int64), np.empty(len(rows))
    norms = np.einsum("ij,ij->i", book, book)
    step = max(1, _CELLS // len(book))
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        d = norms - 2.0 * (part @ book.T)
        code[at : at + step] = best = d.argmin(axis=1)
        loss[at : at + step] = d[np.arange(len(part)), best] + np.einsum("ij,ij->i", part, part)
    return code, loss


def train_codes(base: DataFrame, parts: int, codes: int, seed: int = 0, max_iter: int = 12, train_rows: int | None = None) -> np.ndarray:
    """Codebooks of shape (parts, codes, dims per part) for the vectors ``emb`` of a table with ``id``.

    ``train_rows`` bounds the expected number of rows that are read in training: those whose hash
    of id and vector lies below a share. All rows otherwise. A code that no row is near to stays
    where it was. With ``parts=1`` the codes are centres of lists.
    """
    rows = base.where(F.col("emb").isNotNull() & (F.size("emb") > 0))
    if train_rows is not None:
        share = min(1.0, train_rows / max(rows.count(), 1))
        rows = rows.where(F.pmod(F.xxhash64("id", "emb", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = rows.select("emb")
    points = _candidates(rows, SEED_BUCKETS * codes)
    if not len(points):
        raise ValueError("no vectors to train codes from")
    dim = points.shape[1]
    if dim % parts:
        raise ValueError(f"{dim} components cannot be cut into {parts} parts")
    width, rng = dim // parts, np.random.default_rng(seed)
    books = np.stack([_starts(points[:, m * width : (m + 1) * width], codes, rng) for m in range(parts)])
    before = np.inf
    for _ in range(max_iter):
        means, counts, loss = _iteration(rows, books)
        books = np.where(counts[:, :, None] > 0, means, books)
        if loss >= before * (1.0 - GAIN):
            break
        before = loss
    return books


def _iteration(rows: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Means and numbers of the rows nearest to each code of each part, and the squared distance before the move."""
    parts, codes, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)
    schema = pa.schema([("part", pa.int32()), ("code", pa.int32()), ("n", pa.int64()), ("loss", pa.float64()), ("total", pa.list_(pa.float64()))])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        sums, counts, losses = np.zeros(books.shape), np.zeros((parts, codes), np.int64), np.zeros((parts, codes))
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column(0), width=parts * width).astype(np.float64)
            for m in range(parts):
                piece = np.ascontiguousarray(vectors[:, m * width : (m + 1) * width])
                code, loss = _assign(piece, books[m])
                more, n = _sum_columns(piece, code, codes)
                sums[m] += more
                counts[m] += n
                losses[m] += np.bincount(code, weights=loss, minlength=codes)
        part, code = np.nonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(sums[part, code].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(counts[part, code]), pa.array(losses[part, code]), lists], schema=schema)

    told = rows.mapInArrow(local, "part INT, code INT, n BIGINT, loss DOUBLE, total ARRAY<DOUBLE>")
    added = told.groupBy("part", "code").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), Summarizer.sum(array_to_vector("total")).alias("total"))
    found = added.select("part", "code", "n", "loss", vector_to_array("total").alias("total")).toArrow()  # at most one row per part and code
    part, code, n = (found[c].to_numpy() for c in ("part", "code", "n"))
    means, counts = np.zeros(books.shape), np.zeros((parts, codes), np.int64)
    means[part, code] = matrix(found["total"]).reshape(-1, width) / n[:, None]
    counts[part, code] = n
    shared.unpersist()
    return means, counts, float(found["loss"].to_numpy().sum())
