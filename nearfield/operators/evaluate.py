"""Scores of retrieval runs against ground truth.

``hits`` are ``qid, rank, id`` and ``truth`` is ``qid, gt_rank, id``, both 0-based.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ideal_dcg(k: int) -> float:
    """Gain of a perfect answer of k ids."""
    return sum(1.0 / math.log2(i + 2) for i in range(k))


def score_hits(hits: DataFrame, truth: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """``qid, recall, ndcg`` of every query.

    Recall divides by k even where the truth is shorter, and counts a repeated answer each
    time. nDCG discounts by the place in the *truth*, over the set of answers, so the order
    of an answer does not change it. A truth that repeats an id counts it at its first place.
    Queries without truth or hits score 0.
    """
    wanted = truth.where(F.col("gt_rank") < k).groupBy("qid", "id").agg(F.min("gt_rank").alias("gt_rank"))
    found = (
        hits.where(F.col("rank") < k)
        .groupBy("qid", "id")
        .agg(F.count(F.lit(1)).alias("times"))
        .join(wanted, ["qid", "id"])
        .groupBy("qid")
        .agg(
            (F.sum("times") / F.lit(k)).alias("recall"),
            (F.sum(F.lit(1.0) / F.log2(F.col("gt_rank") + F.lit(2.0))) / F.lit(ideal_dcg(k))).alias("ndcg"),
        )
    )
    asked = (queries if queries is not None else truth).select("qid").distinct()
    return asked.join(found, "qid", "left").select(
        "qid",
        F.coalesce("recall", F.lit(0.0)).alias("recall"),
        F.coalesce("ndcg", F.lit(0.0)).alias("ndcg"),
    )


def recall_at_k(hits: DataFrame, truth: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    return score_hits(hits, truth, k, queries).select("qid", "recall")


def ndcg_at_k(hits: DataFrame, truth: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    return score_hits(hits, truth, k, queries).select("qid", "ndcg")


def recall_fts(hits: DataFrame, truth: DataFrame, k: int, queries: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """Text recall: distinct answers among the first k that are true, over the *whole* truth set."""
    wanted = truth.select("qid", id_col).distinct()
    answers = hits.where((F.col("rank") < k) & F.lit(k > 0)).select("qid", id_col).distinct().withColumn("hit", F.lit(1))
    scored = (
        wanted.join(answers, ["qid", id_col], "left")
        .groupBy("qid")
        .agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    )
    if queries is None:
        return scored
    return queries.select("qid").distinct().join(scored, "qid", "left").select(
        "qid", F.coalesce("recall", F.lit(0.0)).alias("recall")
    )


def recall_of_lists(k: int, truth: Column, answer: Column) -> Column:
    """``recall`` of two id arrays in one row."""
    wanted = F.slice(truth, 1, k)
    return F.size(F.filter(F.slice(answer, 1, k), lambda x: F.array_contains(wanted, x))) / F.lit(k)


def rollup(scores: DataFrame, by: str = "run", measure_recall: bool = True) -> DataFrame:
    """Mean recall and nDCG, query count and total cost of each run, rounded to 4 decimals.

    Runs that do not measure recall report 0. ``latency_s`` is optional.
    """
    zero = F.lit(0.0)
    cost = F.sum("latency_s") if "latency_s" in scores.columns else zero
    return scores.groupBy(by).agg(
        F.count(F.lit(1)).alias("queries"),
        (F.round(F.avg("recall"), 4) if measure_recall else F.max(zero)).alias("avg_recall"),
        (F.round(F.avg("ndcg"), 4) if measure_recall else F.max(zero)).alias("avg_ndcg"),
        F.round(cost if "latency_s" in scores.columns else F.max(zero), 4).alias("cost_s"),
    )
