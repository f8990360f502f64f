"""Clustered and quantised searches.

The base table carries the number of its nearest centroid (``list_id``); a query probes the
lists of its ``nprobe`` nearest centroids and meets only those rows. Stored with
``partitionBy("list_id")``, unprobed lists are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vector import binary_quantize, lower_is_nearer, metric
from nearfield.operators.fetch import attach
from nearfield.operators.kernels import ProductKernel
from nearfield.operators.nearest import nearest, nearest_refined, pair_distance, shown, top_k
from nearfield.operators.quantize import ProductCodec, ScalarCodec, nearest_index, nearest_indexes
from nearfield.sizing import broadcast_bounded, broadcast_if_small, settle
from nearfield.sources.tables import dense_row_ids


def assign_lists(base: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add ``list_id``, the nearest centroid of each row. No shuffle."""
    return base.withColumn("list_id", nearest_index(F.col("emb"), centroids))


def probe_lists(queries: DataFrame, centroids: np.ndarray, nprobe: int) -> DataFrame:
    """One row per query and probed list: ``qid, emb, list_id, probe_rank``."""
    lists = F.posexplode(nearest_indexes(F.col("emb"), centroids, nprobe)).alias("probe_rank", "list_id")
    return queries.select("qid", "emb", lists)


def probed(queries: DataFrame, centroids: np.ndarray, nprobe: int, once: bool = False) -> DataFrame:
    """One row per query with its probed lists, nearest first: ``qid, emb, list_id`` (an array)."""
    return queries.select("qid", "emb", nearest_indexes(F.col("emb"), centroids, nprobe, once=once).alias("list_id"))


def knn_ivf_flat(base: DataFrame, queries: DataFrame, k: int, centroids: np.ndarray, nprobe: int, metric_name: str = "l2") -> DataFrame:
    """Exact distances, only inside the probed lists. ``base`` may already carry ``list_id``."""
    listed = base if "list_id" in base.columns else assign_lists(base, centroids)
    return nearest(listed, probed(queries, centroids, nprobe), k, metric_name, key="list_id")


def knn_ivf_sq8(base: DataFrame, queries: DataFrame, k: int, centroids: np.ndarray, nprobe: int, codec: ScalarCodec) -> DataFrame:
    """Full queries against decoded scalar codes, inside the probed lists."""
    listed = base if "list_id" in base.columns else assign_lists(base, centroids)
    coded = listed.select("id", "list_id", codec.encode(F.col("emb")).alias("code"))
    decoded = coded.select("id", "list_id", codec.decode(F.col("code")).alias("emb"))
    return nearest(decoded, probed(queries, centroids, nprobe), k, "l2", key="list_id")


def knn_ivf_pq(base: DataFrame, queries: DataFrame, k: int, centroids: np.ndarray, nprobe: int, codec: ProductCodec) -> DataFrame:
    """Table look-up distances (squared L2) over product codes, inside the probed lists."""
    listed = base if "list_id" in base.columns else assign_lists(base, centroids)
    coded = listed.select("id", "list_id", codec.encode(F.col("emb")).alias("emb"))
    books = codec.codebooks
    return nearest(
        coded, probed(queries, centroids, nprobe), k, key="list_id", kernel=lambda rows: ProductKernel(books, rows)
    )


def knn_binary(base: DataFrame, queries: DataFrame, k: int, metric_name: str = "hamming") -> DataFrame:
    """Rank by distance between sign bits only."""
    return nearest(_bits(base), _bits(queries), k, metric_name)


def _bits(df: DataFrame) -> DataFrame:
    return df.withColumn("emb", binary_quantize(F.col("emb")))


def _with_bits(df: DataFrame) -> DataFrame:
    """Sign bits as ``emb`` and the vector as ``full``."""
    return _bits(df.where(F.col("emb").isNotNull()).withColumn("full", F.col("emb")))


def refines(base: DataFrame, metric_name: str) -> bool:
    """Whether candidates may be measured where they are read: ids stand for one row each, and the measure is built in."""
    if metric_name not in ("l2", "cos", "ip", "dp"):
        return False
    rows, ids = base.agg(F.count("id"), F.count_distinct("id")).first()
    return rows == ids


def rerank(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int, fetch: int, metric_name: str = "cos") -> DataFrame:
    """Measure fetched candidates exactly and keep k.

    The full vectors meet at most ``queries x fetch`` candidate rows; that bound decides how the
    candidates reach the base table, whose rows are not moved to be joined.
    """
    expression, ascending = metric(metric_name)
    asked = queries.select("qid", F.col("emb").alias("q_emb")).dropDuplicates(["qid"])
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("q_emb")), F.lit(0))).first()
    rows = attach(base.select("id", F.col("emb").alias("b_emb")), candidates.select("qid", "id"), n * fetch, row_bytes=32)
    rows = rows.join(broadcast_bounded(asked, n, 64 + 8 * (size // max(n, 1))), "qid")
    if metric_name in ("l2", "cos", "ip", "dp"):
        distance = pair_distance(metric_name, F.col("q_emb"), F.col("b_emb"))
        score = distance if ascending else -distance
    else:
        score = expression("q_emb", "b_emb")
    known = rows.where(F.col("b_emb").isNotNull() & F.col("q_emb").isNotNull())
    scored = known.select("qid", "id", (score + F.lit(0.0)).alias("score"))
    best = top_k(scored.where(F.col("score").isNotNull()), k, ascending=ascending)
    return best.select("qid", "rank", "id", shown(F.col("score")).alias("score"))


def knn_rerank(base: DataFrame, queries: DataFrame, k: int, oversample: int, metric_name: str = "cos", fetch_limit: int | None = None) -> DataFrame:
    """Fetch ``k * oversample`` (or ``fetch_limit``) rows by sign bits, re-rank by the true metric."""
    fetch = max(fetch_limit or k * oversample, k)
    if refines(base, metric_name):
        return nearest_refined(_with_bits(base), _with_bits(queries), k, [fetch], metric_name).drop("cut")
    return rerank(knn_binary(base, queries, fetch), base, queries, k, fetch, metric_name)


def knn_ivf_bq(base: DataFrame, queries: DataFrame, k: int, centroids: np.ndarray, nprobe: int, refine_k: int, metric_name: str = "l2") -> DataFrame:
    """Sign-bit ranking inside the probed lists, then an exact refine of ``k * refine_k`` rows."""
    listed = base if "list_id" in base.columns else assign_lists(base, centroids)
    probes = probed(queries, centroids, nprobe, once=True)
    if refines(base, metric_name):
        return nearest_refined(_with_bits(listed), _with_bits(probes), k, [k * refine_k], metric_name, key="list_id").drop("cut")
    fetched = nearest(_bits(listed), _bits(probes), k * refine_k, "hamming", key="list_id")
    return rerank(fetched, base, queries, k, k * refine_k, metric_name)


def search_parts(base: DataFrame, asked: DataFrame, n_parts: int, k: int, part: str, metric_name: str = "l2", cuts: list[int] | None = None, fine: str | None = None) -> DataFrame:
    """The k nearest rows of every (query, part): ``qid, part, rank, id, score``.

    ``asked`` names the parts each query meets in column ``part`` (0 .. n_parts - 1) and
    the value of the ``key`` column shared with ``base``, or an array of values. With ``fine`` the sign bits in ``emb``
    are searched and the best k of the first rows of each ``cuts`` by the vector ``full`` are kept: ``cut`` and the rest.
    """
    # One number per (query, part). Numbers of queries stay below the count of queries, so any 64-bit id fits.
    numbered = _numbered(asked.select("qid").distinct())
    full = ["full"] if fine else []
    unit = asked.join(broadcast_if_small(numbered), "qid").select((F.col("_number") * F.lit(n_parts) + F.col(part)).alias("qid"), "emb", *full, "key")
    hits = nearest_refined(base, unit, k, cuts, fine, key="key") if fine else nearest(base, unit, k, metric_name, key="key")
    columns = [*(["cut"] if fine else []), "rank", "id", "score"]
    found = hits.select(F.expr(f"qid div {n_parts}").alias("_number"), F.expr(f"cast(qid % {n_parts} AS int)").alias("part"), *columns)
    return found.join(broadcast_if_small(numbered), "_number").select("qid", "part", *columns)


def _numbered(ids: DataFrame) -> DataFrame:
    """Consecutive numbers for distinct ids, the same in every use of the result."""
    stored = settle(ids)
    return settle(dense_row_ids(stored, "qid").select("qid", F.col("row_id").alias("_number")))


def recut(per_part: DataFrame, grid: list[int], k: int, setting: str, ascending: bool = True) -> DataFrame:
    """Top k over the parts below each setting of the grid: ``setting, qid, rank, id, score``."""
    settings = F.filter(F.array(*[F.lit(p) for p in sorted(grid)]), lambda p: p > F.col("part"))
    cuts = per_part.withColumn(setting, F.explode(settings)).withColumn("unit", F.struct(setting, "qid"))
    return top_k(cuts, k, group="unit", ascending=ascending).select(setting, "qid", "rank", "id", "score")


def _settings(queries: DataFrame, centroids: np.ndarray, grid: list[int]) -> DataFrame:
    """One row per query and setting of a sorted grid, with the lists it probes: ``qid, emb, part, key``."""
    lists = probed(queries, centroids, max(grid))
    parts = F.explode(F.transform(F.array(*[F.lit(p) for p in grid]), lambda p, i: F.struct(i.alias("part"), F.slice("list_id", F.lit(1), p).alias("key")))).alias("_part")
    return lists.select("qid", "emb", parts).select("qid", "emb", F.col("_part.part").alias("part"), F.col("_part.key").alias("key"))


def sweep_nprobe(base: DataFrame, queries: DataFrame, k: int, centroids: np.ndarray, grid: list[int], metric_name: str = "l2") -> DataFrame:
    """Hits for every ``nprobe`` in the grid from one search: ``nprobe, qid, rank, id, score``.

    A setting of a query is searched as a query of its own, so that k rows are kept of each and not of each list.
    """
    listed = base if "list_id" in base.columns else assign_lists(base, centroids)
    grid = sorted(set(grid))
    found = search_parts(listed.withColumn("key", F.col("list_id")), _settings(queries, centroids, grid), len(grid), k, "part", metric_name)
    return found.select(_setting(grid).alias("nprobe"), "qid", "rank", "id", "score")


def _setting(grid: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in grid]), F.col("part") + 1)


def scan_cost(base_lists: DataFrame, probes: DataFrame, grid: list[int]) -> DataFrame:
    """Rows measured per ``nprobe``: the sizes of the probed lists, summed over the queries."""
    sizes = base_lists.groupBy("list_id").agg(F.count(F.lit(1)).alias("rows"))
    settings = F.filter(F.array(*[F.lit(p) for p in sorted(grid)]), lambda p: p > F.col("probe_rank"))
    asked = probes.groupBy("list_id", "probe_rank").agg(F.count(F.lit(1)).alias("asks"))
    return (
        asked.join(sizes, "list_id")
        .withColumn("nprobe", F.explode(settings))
        .groupBy("nprobe")
        .agg(F.sum(F.col("rows") * F.col("asks")).alias("rows_scanned"))
    )


def sweep_grid(base: DataFrame, queries: DataFrame, k: int, centroids: np.ndarray, nprobes: list[int], oversamples: list[int], metric_name: str = "l2") -> DataFrame:
    """Hits of sign-bit search and exact refine for every pair of settings, from one search: ``nprobe, oversample, qid, rank, id, score``.

    The search keeps the ``k * max(oversamples)`` first rows by sign bits of every query and ``nprobe``, with their
    distances; each ``oversample`` cuts their places, and the distances rank what is left.
    """
    listed = base if "list_id" in base.columns else assign_lists(base, centroids)
    grid, cuts = sorted(set(nprobes)), {k * o: o for o in oversamples}
    asked, keyed = _settings(queries, centroids, grid), listed.withColumn("key", F.col("list_id"))
    if refines(base, metric_name):
        best = search_parts(_with_bits(keyed), _with_bits(asked), len(grid), k, "part", cuts=list(cuts), fine=metric_name)
        oversample = F.element_at(F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair]), F.col("cut"))
        return best.select(_setting(grid).alias("nprobe"), oversample.alias("oversample"), "qid", "rank", "id", "score")
    fetch = k * max(oversamples)
    fetched = settle(search_parts(_bits(keyed), _bits(asked), len(grid), fetch, "part", "hamming").select("qid", "part", "id", F.col("score").alias("code")))
    vectors = queries.select("qid", F.col("emb").alias("q_emb")).where(F.col("q_emb").isNotNull()).dropDuplicates(["qid"])
    near = attach(base.select("id", F.col("emb").alias("b_emb")), fetched, queries.count() * len(grid) * fetch)
    ascending = lower_is_nearer(metric_name)
    distance = pair_distance(metric_name, F.col("q_emb"), F.col("b_emb"))
    score = distance if ascending else -distance
    measured = near.join(broadcast_if_small(vectors), "qid").select(_setting(grid).alias("nprobe"), "qid", "id", "code", (score + F.lit(0.0)).alias("score"))
    measured = settle(measured.where(F.col("score").isNotNull())).withColumn("unit", F.struct("nprobe", "qid"))
    placed = top_k(measured, fetch, group="unit", score="code").withColumnRenamed("rank", "place")
    refined = _by_setting(placed, F.floor(F.col("place") / k), oversamples, "oversample").withColumn("unit", F.struct("nprobe", "oversample", "qid"))
    best = top_k(refined, k, group="unit", ascending=ascending)
    return best.select("nprobe", "oversample", "qid", "rank", "id", shown(F.col("score")).alias("score"))


def _by_setting(rows: DataFrame, cut: Column | str, grid: list[int], name: str) -> DataFrame:
    """Every row once for each setting above its value."""
    at = F.col(cut) if isinstance(cut, str) else cut
    return rows.withColumn(name, F.explode(F.filter(F.array(*[F.lit(g) for g in sorted(grid)]), lambda g: g > at)))


def grid_cost(base_lists: DataFrame, probes: DataFrame, nprobes: list[int], oversamples: list[int], k: int) -> DataFrame:
    """``nprobe, oversample, rows_scanned, rows_refined``: rows compared by code and rows measured again, summed over the queries."""
    sizes = base_lists.groupBy("list_id").agg(F.count(F.lit(1)).alias("rows"))
    asked = _by_setting(probes.select("qid", "list_id", "probe_rank").join(sizes, "list_id"), "probe_rank", nprobes, "nprobe")
    each = asked.groupBy("nprobe", "qid").agg(F.sum("rows").alias("rows")).withColumn("oversample", F.explode(F.array(*[F.lit(o) for o in oversamples])))
    refined = F.sum(F.least("rows", F.col("oversample") * F.lit(k)))
    return each.groupBy("nprobe", "oversample").agg(F.sum("rows").alias("rows_scanned"), refined.alias("rows_refined"))
