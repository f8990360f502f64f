"""Approximate nearest neighbours by multi-index hashing.

Vectors are centred, rotated by a matrix learned on a sample (principal axes, then iterative
quantisation) and cut to sign bits. The bits are split into substrings and every substring is
indexed. If two codes differ in at most ``radius`` bits, one substring differs in at most its
share of them, so probing all indexed values within that share finds every code within the
radius. What is found is ranked by the true distance. The radius is the one that covers the
wanted share of true neighbours within the sample, whose neighbours lie farther apart than
those of the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import stored
from nearfield.session import work_dir

SAMPLE_ROWS = 10_000
SAMPLE_QUERIES = 500
COVER = 0.97
CHUNK = 20_000
QUERY_BLOCK = 10_000
PIECE_BITS = 16
_ONES = np.array([bin(i).count("1") for i in range(1 << PIECE_BITS)], np.uint8)


@dataclass(frozen=True)
class Coder:
    mean: np.ndarray
    rotation: np.ndarray

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """One row of 16-bit pieces per vector; the last piece is filled up with zero bits."""
        bits = np.packbits((vectors - self.mean) @ self.rotation > 0, axis=1)
        pieces = -(-self.rotation.shape[1] // PIECE_BITS)
        return np.pad(bits, ((0, 0), (0, 2 * pieces - bits.shape[1]))).view(">u2").astype(np.uint16)


def learn(vectors: np.ndarray, rounds: int = 30, seed: int = 0) -> Coder:
    """Rotation to principal axes and from there to the signs nearest to the vectors."""
    mean = vectors.mean(0)
    centred = vectors - mean
    axes = np.linalg.eigh(centred.T @ centred)[1]
    turned = centred @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(axes), len(axes))))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(turned.T @ np.sign(turned @ rotation))
        rotation = u @ v
    return Coder(mean, axes @ rotation)


def apart(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return _ONES[codes ^ code].sum(1, dtype=np.int32)


def radius_for(coder: Coder, vectors: np.ndarray, k: int, cover: float) -> int:
    """Least radius that holds the wanted share of the sample's true neighbours."""
    codes, seen = coder.codes(vectors), []
    for q in range(min(SAMPLE_QUERIES, len(vectors))):
        far = ((vectors - vectors[q]) ** 2).sum(1)
        far[q] = np.inf
        near = np.argsort(far, kind="stable")[: min(k, len(vectors) - 1)]
        seen.append(apart(codes[near], codes[q]))
    found = np.sort(np.concatenate(seen)) if seen else np.zeros(0, np.int32)
    return int(found[min(len(found) - 1, int(np.ceil(cover * len(found))))]) if len(found) else 0


def shares(radius: int, pieces: int) -> list[int]:
    """Radius of each substring; below zero where it need not be probed."""
    whole, rest = divmod(radius, pieces)
    return [whole if piece <= rest else whole - 1 for piece in range(pieces)]


def _valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v``: rows with an id and a vector that is not zero and has only finite components, of the most frequent length."""
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    widths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (widths.n if widths else 0))


def _build(coder: Coder):
    """Chunks of the index: ids, vectors, codes, and for each substring the rows in the order of its values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), CHUNK):
                part = batch.slice(start, CHUNK)
                lists = part.column("v")
                vectors = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1).astype(np.float64)
                codes = coder.codes(vectors)
                orders = np.argsort(codes, axis=0, kind="stable").astype(np.int32)
                blobs = [part.column("id").to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False), codes, orders.T]
                columns = [pa.array([np.ascontiguousarray(b).tobytes()], pa.binary()) for b in blobs]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(part)], pa.int32())], ["ids", "vectors", "codes", "orders", "n"])

    return run


class Chunk:
    def __init__(self, row: dict, kind: str):
        n = row["n"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], kind).reshape(n, -1)
        self.codes = np.frombuffer(row["codes"], np.uint16).reshape(n, -1)
        self.pieces = []
        for piece, order in enumerate(np.frombuffer(row["orders"], np.int32).reshape(-1, n)):
            values = self.codes[order, piece]
            starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
            self.pieces.append((order, values[starts], starts, np.diff(np.r_[starts, n])))

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs in at most ``radius`` bits."""
        found = np.zeros(len(self.ids), bool)
        for (order, values, starts, sizes), value, share in zip(self.pieces, code, shares(radius, len(self.pieces))):
            if share >= 0:
                hit = _ONES[values ^ value] <= share
                found[order[np.repeat(hit, sizes)]] = True
        rows = np.flatnonzero(found)
        return rows[apart(self.codes[rows], code) <= radius]

    def nearest(self, query_id: int, query: np.ndarray, code: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.probe(code, radius)
        rows = rows[self.ids[rows] != query_id]
        score = np.sqrt(((self.vectors[rows].astype(np.float64) - query) ** 2).sum(1))
        wanted = k
        while len(rows) > 2 * wanted:  # sort only what is no farther than the k-th; more, while ids repeat
            near = score <= np.partition(score, wanted - 1)[wanted - 1]
            if len(np.unique(self.ids[rows[near]])) >= k:
                rows, score = rows[near], score[near]
                break
            wanted *= 4
        order = np.lexsort((self.ids[rows], score))
        ids = self.ids[rows[order]]
        first = np.sort(np.unique(ids, return_index=True)[1])[:k]
        return ids[first], score[order][first]


def _search(queries: pa.Table, coder: Coder, radius: int, k: int, kind: str):
    ids = queries["id"].to_numpy()
    vectors = queries["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)
    codes = coder.codes(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row, kind)
                found = [chunk.nearest(i, v, c, radius, k) for i, v, c in zip(ids.tolist(), vectors, codes)]
                sizes = [len(f) for f, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([f for f, _ in found])), pa.array(np.concatenate([s for _, s in found]))], ["query_id", "id", "score"]
                )

    return run


def search(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding", cover: float = COVER) -> DataFrame:
    """The ``k`` nearest rows found for each query row: ``query_id, rank, id, score``.

    ``is_query`` is a condition on the key, called ``id`` here. Rows without an id, and vectors
    that are null, zero, of another length than most, or hold a null or non-finite component,
    take no part. Ids are 64-bit whole numbers. A query never finds a row of its own id; rows
    that repeat an id count once, with the nearest of their vectors, and as one query with the
    least of them. Ties go to the smaller id. A query that finds fewer than ``k`` rows within
    the radius is held against all rows. The rotation and the radius come from at most
    ``SAMPLE_ROWS`` rows; all rows are indexed.
    """
    spark = vectors.sparkSession
    valid = _valid(vectors, key, vector)
    element = valid.schema["v"].dataType.elementType.simpleString()
    kind = {"float": "<f4", "double": "<f8"}.get(element)
    if kind is None:
        valid, kind = valid.withColumn("v", F.col("v").cast("array<double>")), "<f8"
    valid = valid.withColumn("id", F.col("id").cast("bigint"))
    sample = valid.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE_ROWS).toArrow()
    empty = spark.createDataFrame([], "query_id BIGINT, rank INT, id BIGINT, score DOUBLE")
    if not len(sample):
        return empty
    learned = sample["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(sample), -1).astype(np.float64)
    coder = learn(learned)
    radius = radius_for(coder, learned, k, cover)
    index = stored(valid.mapInArrow(_build(coder), "ids BINARY, vectors BINARY, codes BINARY, orders BINARY, n INT"), "hamming-index")
    queries = stored(valid.where(is_query).groupBy("id").agg(F.min("v").alias("v")), "queries")
    asked, rows = queries.count(), index.agg(F.sum("n")).first()[0]
    folder = work_dir(spark, "hits")
    blocks = -(-asked // QUERY_BLOCK)
    written: list[str] = []
    for number in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toArrow()
        if not len(block):
            continue
        written.append(f"{folder}/{number}")
        hits = stored(_ranked(index, block, coder, radius, k, kind), "block-hits")
        full = hits.groupBy("query_id").count().where(F.col("count") >= min(k, rows - 1)).select("query_id").toArrow()
        short = block.filter(pa.compute.invert(pa.compute.is_in(block["id"], full["query_id"].combine_chunks())))
        if len(short):
            again = _ranked(index, short, coder, coder.rotation.shape[1], k, kind)
            done = spark.createDataFrame(full) if len(full) else empty.select("query_id")
            hits = hits.join(F.broadcast(done), "query_id", "left_semi").unionByName(again)
        hits.write.parquet(written[-1])
    return spark.read.parquet(*written) if written else empty


def _ranked(index: DataFrame, block: pa.Table, coder: Coder, radius: int, k: int, kind: str) -> DataFrame:
    found = index.mapInArrow(_search(block, coder, radius, k, kind), "query_id BIGINT, id BIGINT, score DOUBLE")
    best = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
