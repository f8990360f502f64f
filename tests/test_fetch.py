"""Wide rows for found ids: all three ways give the same join, and the wide side stays where it is read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield import sizing
from nearfield.operators import fetch as X
from nearfield.operators.ann import knn_rerank
from nearfield.operators.nearest import nearest

WAYS = {"broadcast": None, "packed": 1 << 20, "filtered": 0}


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("wide") / "table")
    rows = spark.range(20_000).select("id", F.concat(F.lit("payload "), "id").alias("text"), F.array("id", "id").alias("emb"))
    extra = spark.createDataFrame([(7, "again", [1, 2]), (None, "no id", [])], "id BIGINT, text STRING, emb ARRAY<BIGINT>")
    rows.union(extra).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def hits(spark):
    rows = [(q, (q * 37 + r * 911) % 21_000, r, 0.5 * r) for q in range(40) for r in range(5)] + [(900, 7, 0, None), (901, 7, 1, 2.0), (902, None, 0, 1.0), (903, -5, 0, 1.0)]
    return spark.createDataFrame(rows, "qid BIGINT, id BIGINT, rank INT, score DOUBLE").repartition(3)


def joined(way, monkeypatch, wide, hits):
    if WAYS[way] is not None:
        monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", 0)
    return X.attach(wide, hits, 1000, packed_bytes=WAYS[way])


@pytest.mark.parametrize("way", WAYS)
def test_same_rows_in_every_way(monkeypatch, wide, hits, way):
    got = joined(way, monkeypatch, wide, hits)
    want = wide.join(hits, "id")
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert joined(way, monkeypatch, wide, hits.where("false")).count() == 0


def test_the_wide_side_is_not_exchanged(spark, monkeypatch, wide, hits):
    plan = joined("packed", monkeypatch, wide, hits)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joined("filtered", monkeypatch, wide, hits)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    side = plan[plan.index("Exchange") :].split("Exchange")[1]
    assert "ArrowEvalPython" in side and "Scan parquet" in side  # the filter stands between the scan and the exchange


def test_text_ids(spark, monkeypatch):
    monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(f"d{i}", i) for i in range(500)], "doc_id STRING, n INT")
    hits = spark.createDataFrame([("d3", 1), ("d499", 2), ("x", 3), (None, 4)], "doc_id STRING, qid INT")
    assert sorted((r.doc_id, r.n, r.qid) for r in X.attach(docs, hits, 10, key="doc_id").collect()) == [("d3", 3, 1), ("d499", 499, 2)]


def test_a_filter_holds_its_ids_and_few_others(spark, monkeypatch):
    monkeypatch.setattr(X, "SEGMENT_BITS", 1 << 14)
    own = spark.range(0, 40_000, 4)
    made = X.id_filter(own)
    assert made.size >= 10_000 * X.BITS_PER_ID
    assert own.where(made.holds(F.col("id"))).count() == 10_000
    others = spark.range(1_000_000, 1_050_000)
    assert others.where(made.holds(F.col("id"))).count() < 1000
    assert spark.range(10).where(X.id_filter(own.where("false")).holds(F.col("id"))).count() == 0


def test_rerank_without_moving_the_base(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "id BIGINT, emb ARRAY<DOUBLE>").repartition(3)
    asked = base.where("id < 12").withColumnRenamed("id", "qid")
    want = [tuple(r) for r in nearest(base, asked, 5, "l2").orderBy("qid", "rank").collect()]
    for limit in (0, 1_000_000):
        monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", limit)
        assert [tuple(r) for r in knn_rerank(base, asked, 5, 60, "l2").orderBy("qid", "rank").collect()] == want
