import pytest
from pyspark.sql import functions as F

from nearfield.operators import evaluate as E

TRUTH = [42, 8, 15, 4, 23, 16]


def long(spark, ids, place, qid=1):
    return spark.createDataFrame([(qid, i, x) for i, x in enumerate(ids)], f"qid BIGINT, {place} INT, id BIGINT")


@pytest.mark.parametrize("answer,want", [(TRUTH, 1.0), ([70, 71, 72], 0.0), ([4, 70, 42, 71, 72, 16], 0.5), ([23, 15, 8], 0.5), ([8, 8, 8], 0.5)])
def test_recall(spark, answer, want):
    truth, hits = long(spark, TRUTH, "gt_rank"), long(spark, answer, "rank")
    assert E.recall_at_k(hits, truth, 6).first()["recall"] == want
    row = spark.range(1).select(E.recall_of_lists(6, F.array(*map(F.lit, TRUTH)), F.array(*map(F.lit, answer)))).first()
    assert row[0] == want


def test_ndcg_ignores_the_order_of_the_answer(spark):
    truth = long(spark, TRUTH, "gt_rank")
    values = {round(E.ndcg_at_k(long(spark, a, "rank"), truth, 6).first()["ndcg"], 12) for a in (TRUTH, TRUTH[::-1])}
    assert values == {1.0}
    first, last = (E.ndcg_at_k(long(spark, [x], "rank"), truth, 6).first()["ndcg"] for x in (42, 16))
    assert first > last > 0


def test_a_truth_that_repeats_an_id_counts_it_once(spark):
    row = E.score_hits(long(spark, [5], "rank"), long(spark, [5, 5], "gt_rank"), 2).first()
    assert row.recall == 0.5 and round(row.ndcg, 2) == 0.61


def test_short_truth_lowers_recall_and_missing_truth_is_zero(spark):
    hits = long(spark, [1, 2, 3], "rank").unionByName(long(spark, [1], "rank", qid=2))
    truth = long(spark, [1, 2], "gt_rank")
    asked = spark.createDataFrame([(1,), (2,)], "qid BIGINT")
    got = {r.qid: r.recall for r in E.recall_at_k(hits, truth, 4, asked).collect()}
    assert got == {1: 0.5, 2: 0.0}


def test_text_recall_is_bounded_by_the_whole_truth(spark):
    truth = long(spark, list(range(100)), "gt_rank").withColumnRenamed("id", "doc_id")
    hits = long(spark, list(range(20)), "rank").withColumnRenamed("id", "doc_id")
    assert E.recall_fts(hits, truth, 10).first()["recall"] == 0.1
    assert E.recall_fts(hits, truth, 0).first()["recall"] == 0.0
    asked = spark.createDataFrame([(1,), (9,)], "qid BIGINT")
    assert {r.qid: r.recall for r in E.recall_fts(hits, truth, 10, asked).collect()} == {1: 0.1, 9: 0.0}


def test_rollup_without_recall(spark):
    rows = spark.createDataFrame([("a", 0.5, 0.25, 0.2), ("a", 1.0, 0.75, 0.3)], "run STRING, recall DOUBLE, ndcg DOUBLE, latency_s DOUBLE")
    row = E.rollup(rows).first()
    assert (row.queries, row.avg_recall, row.avg_ndcg, row.cost_s) == (2, 0.75, 0.5, 0.5)
    row = E.rollup(rows, measure_recall=False).first()
    assert (row.avg_recall, row.avg_ndcg, row.cost_s) == (0.0, 0.0, 0.5)
