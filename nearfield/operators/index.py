"""A stored vector index: built once, partitioned by list, searched many times.

The table holds ``id, emb`` and, where asked for, scalar codes, product codes and sign bits
of every row, in one folder per list. A search reads the folders of the probed lists only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions.vector import binary_quantize, l2_normalize
from nearfield.operators.ann import refines, rerank
from nearfield.operators.kernels import ProductKernel
from nearfield.operators.nearest import kernel_for, nearest, nearest_refined
from nearfield.operators.quantize import ProductCodec, ScalarCodec, nearest_index, nearest_indexes
from nearfield.sizing import broadcast_if_small


@dataclass(frozen=True)
class VectorIndex:
    """Where an index lies and how it was made. ``metric`` decides both the list of a row and the lists a query probes."""

    path: str
    centroids: np.ndarray
    metric: str
    scalar: ScalarCodec | None = None
    product: ProductCodec | None = None

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def _points(centroids: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cos":
        return centroids
    lengths = np.linalg.norm(centroids, axis=1, keepdims=True)
    return centroids / np.where(lengths > 0, lengths, 1.0)


def _placed(metric: str):
    """The vector by which a row finds its lists; a vector without direction is taken as it is."""
    emb = F.col("emb")
    return emb if metric != "cos" else F.when(F.exists(emb, lambda x: x != 0), l2_normalize(emb)).otherwise(emb)


def write_index(
    base: DataFrame,
    path: str,
    centroids: np.ndarray,
    metric: str = "l2",
    scalar: ScalarCodec | None = None,
    product: ProductCodec | None = None,
    bits: bool = True,
    keep: tuple[str, ...] = (),
) -> VectorIndex:
    """Store every row with a vector under its list. Lists are split into files by their size, so a large one is not one task."""
    probe = "ip" if metric in ("ip", "dp") else "l2"
    rows = base.where(F.col("emb").isNotNull() & F.col("id").isNotNull())
    columns = [F.col("id").cast("bigint").alias("id"), F.col("emb"), *[F.col(c) for c in keep], nearest_index(_placed(metric), _points(centroids, metric), probe).alias("list_id")]
    if scalar:
        columns.append(scalar.encode(F.col("emb")).alias("sq"))
    if product:
        columns.append(product.encode(F.col("emb")).alias("pq"))
    if bits:
        columns.append(binary_quantize(F.col("emb")).alias("bits"))
    rows.select(*columns).hint("rebalance", "list_id").write.partitionBy("list_id").parquet(path)
    return VectorIndex(path, centroids, metric, scalar, product)


def search_index(index: VectorIndex, queries: DataFrame, k: int, nprobe: int, kind: str = "flat", refine: int = 0) -> DataFrame:
    """The k nearest rows inside the probed lists: ``qid, rank, id, score``.

    ``kind`` is what is compared: ``flat`` vectors, ``sq`` decoded scalar codes, ``pq`` product
    codes (squared L2) or sign ``bits``. With ``refine`` the best ``k * refine`` rows are
    measured again on the stored vectors of their lists.
    """
    spark = queries.sparkSession
    stored = index.rows(spark)
    probe = "ip" if index.metric in ("ip", "dp") else "l2"
    probes = queries.where(F.col("emb").isNotNull()).select("qid", "emb")
    key = "list_id" if nprobe < len(index.centroids) else None
    if key:  # with every list probed, lists rule nothing out
        lists = nearest_indexes(_placed(index.metric), _points(index.centroids, index.metric), nprobe, probe)
        probes = probes.withColumn("list_id", lists)
    fetch, kernel, coded, asked = k * refine if refine else k, kernel_for(index.metric), F.col("emb"), F.col("emb")
    if kind == "sq":
        coded = index.scalar.decode(F.col("sq"))
    elif kind == "pq":
        books, coded = index.product.codebooks, F.col("pq")
        kernel = lambda rows: ProductKernel(books, rows)
    elif kind == "bits":
        kernel, coded, asked = kernel_for("hamming"), F.col("bits"), binary_quantize(F.col("emb"))
    elif kind != "flat":
        raise ValueError(f"unknown kind {kind!r}")
    if refine and refines(stored, index.metric):
        rows, full = stored.select("id", "list_id", coded.alias("emb"), F.col("emb").alias("full")), probes.withColumn("full", F.col("emb"))
        return nearest_refined(rows, full.withColumn("emb", asked), k, [fetch], index.metric, key, kernel).drop("cut")
    rows = stored.select("id", "list_id", coded.alias("emb"))
    shown_as = {"pq": "l2", "bits": "hamming"}.get(kind, index.metric)
    found = nearest(rows, probes.withColumn("emb", asked), fetch, shown_as, key, kernel)
    return rerank(found, stored, queries, k, fetch, index.metric) if refine else found


def probe_curve(index: VectorIndex, queries: DataFrame, truth: DataFrame) -> DataFrame:
    """``nprobe, found``: how many true neighbours lie in the first ``nprobe`` lists of their query.

    No search is run: a true neighbour (``qid, id``) is found by exact distances inside the probed
    lists as soon as its own list is probed. The rows of the index meet ``truth`` by id; choose a
    sample of queries that keeps it small.
    """
    spark, probe = queries.sparkSession, "ip" if index.metric in ("ip", "dp") else "l2"
    points = _points(index.centroids, index.metric)
    order = nearest_indexes(_placed(index.metric), points, len(points), probe)
    asked = queries.where(F.col("emb").isNotNull()).select("qid", order.alias("lists"))
    lists = index.rows(spark).select("id", "list_id").join(broadcast_if_small(truth.select("qid", "id")), "id")
    places = lists.join(broadcast_if_small(asked), "qid").select(F.array_position("lists", F.col("list_id")).cast("int").alias("place"))
    counts = places.groupBy("place").agg(F.count(F.lit(1)).alias("n"))  # at most one row per list
    return counts.select(F.col("place").alias("nprobe"), F.sum("n").over(Window.orderBy("place")).alias("found"))


def probes_for(index: VectorIndex, queries: DataFrame, truth: DataFrame, share: float) -> int:
    """The least number of probed lists that hold the given share of the true neighbours."""
    curve = probe_curve(index, queries, truth).orderBy("nprobe").toArrow()
    nprobe, found = curve["nprobe"].to_numpy(), curve["found"].to_numpy()
    if not len(found):
        return 1
    return int(nprobe[np.searchsorted(found, share * found[-1])])
