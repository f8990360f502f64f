"""Ground-truth neighbour tables, one per filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.labels import int_truth_table, label_truth_table
from nearfield.operators.nearest import PARTIAL_HITS, nearest, prepare_queries


def neighbor_lists(hits: DataFrame) -> DataFrame:
    """One row per query with its ids in rank order: ``qid, neighbors``. At most k ids per row."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id")))
    return hits.groupBy("qid").agg(F.transform(ordered, lambda h: h["id"]).alias("neighbors"))


def explode_truth(truth: DataFrame) -> DataFrame:
    """Long form of neighbour lists: ``qid, gt_rank, id``."""
    return truth.select("qid", F.posexplode("neighbors").alias("gt_rank", "id"))


def truth_filters(size: int, int_rates: list[float] | None = None, labels: dict[float, Column] | None = None) -> list[tuple[str, Column | None]]:
    """Table name and row predicate of every truth table of a dataset."""
    out: list[tuple[str, Column | None]] = [("neighbors", None)]
    for rate in int_rates or []:
        out.append((int_truth_table(rate), F.col("id") >= F.lit(int(size * rate))))
    for share, predicate in (labels or {}).items():
        out.append((label_truth_table(share), predicate))
    return out


def build_ground_truth(base: DataFrame, queries: DataFrame, k: int, filters: list[tuple[str, Column | None]], metric: str = "cos") -> DataFrame:
    """Exact neighbours under every filter: ``filter_key, qid, gt_rank, id``.

    Each filter sits below its search, so it prunes the scan. The union is one plan, and the queries are prepared once.
    """
    out: DataFrame | None = None
    asked = prepare_queries(queries, most=PARTIAL_HITS // max(1, k))
    for name, predicate in filters:
        rows = base if predicate is None else base.where(predicate)
        part = nearest(rows, asked, k, metric).select(
            F.lit(name).alias("filter_key"), "qid", F.col("rank").alias("gt_rank"), "id"
        )
        out = part if out is None else out.unionByName(part)
    return out


def write_ground_truth(truth: DataFrame, path: str) -> None:
    """Store neighbour lists partitioned by filter."""
    ordered = F.array_sort(F.collect_list(F.struct("gt_rank", "id")))
    lists = truth.groupBy("filter_key", "qid").agg(F.transform(ordered, lambda h: h["id"]).alias("neighbors"))
    lists.write.mode("overwrite").partitionBy("filter_key").parquet(path)
