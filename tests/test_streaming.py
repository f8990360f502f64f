import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators.nearest import nearest
from nearfield.streaming import ingest as I
from nearfield.streaming import live as L
from nearfield.streaming import stages as S


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(21)
    rows = [(i, rng.normal(size=8).tolist(), i) for i in range(300)]
    base = I.add_ticks(spark.createDataFrame(rows, "id BIGINT, emb ARRAY<FLOAT>, row_id BIGINT"), 50).select("id", "emb", "tick").cache()
    queries = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(9)], "qid BIGINT, emb ARRAY<FLOAT>")
    truth = nearest(base, queries, 10, "cos").select("qid", F.col("rank").alias("gt_rank"), "id").cache()
    return base, queries, truth


def run(stream, sink, path):
    query = stream.writeStream.option("checkpointLocation", path).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def test_rates():
    assert [I.effective_rate(r, 100) for r in (500, 550, 99, 100)] == [500, 500, 100, 100]
    assert I.ideal_duration(1001, 500) == 3
    assert S.stage_targets(1000, 100, [0.5, 0.75]) == [(50, 5), (75, 7)]


def test_incremental_hits_equal_batch_hits(spark, data, tmp_path):
    base, queries, _ = data
    schema = I.write_ticks(base, str(tmp_path / "in"))
    sink = L.IncrementalTopK(spark, str(tmp_path / "hits"), queries, 10)
    ticks = {}

    def watched(batch, batch_id):
        ticks[batch_id] = [r.tick for r in batch.select("tick").distinct().collect()]
        sink(batch, batch_id)

    run(I.read_ticks(spark, str(tmp_path / "in"), schema, 2), watched, str(tmp_path / "cp"))
    assert sink.versions()[-1] >= 2
    want = sorted(tuple(r) for r in nearest(base, queries, 10, "cos").collect())
    assert sorted(tuple(r) for r in sink.hits().collect()) == want
    sink(base.where(F.col("tick").isin(ticks[sink.versions()[-1]])), sink.versions()[-1])  # a repeated batch changes nothing
    assert sorted(tuple(r) for r in sink.hits().collect()) == want


def test_stages_in_batch_and_stream_agree(spark, data, tmp_path):
    base, queries, truth = data
    targets = S.stage_targets(300, 50, [0.5, 1.0])
    batch = S.stage_recall(S.stage_hits(base, queries, targets, 10), truth, queries, [50, 100], 10)
    rows = {r.stage: tuple(r)[1:] for r in batch.collect()}
    assert rows[100] == (1.0, 1.0, 1.0, 1.0) and 0.2 < rows[50][0] < 0.8 and rows[50][2] == round(rows[50][0] / 50 * 100, 4)
    schema = I.write_ticks(base, str(tmp_path / "in"))
    sink = S.StagedLoad(spark, str(tmp_path / "out"), queries, truth, S.stage_targets(300, 50, [0.5]), 10)
    run(I.read_ticks(spark, str(tmp_path / "in"), schema, 1), sink, str(tmp_path / "cp"))
    sink.finish()
    streamed = {r.stage: tuple(r)[1:] for r in sink.results().collect()}
    assert streamed[100] == streamed[110] == rows[100] and set(streamed) == {50, 100, 110}
    assert sink.rows().count() == 300


def test_stage_progress(spark):
    ticks = spark.createDataFrame([(0, 0), (0, 1), (2, 2), (2, 2), (5, 3), (7, 3)], "event BIGINT, tick BIGINT")
    got = {r.stage: (r.reached, r.at_event) for r in S.stage_progress(ticks, [(50, 2), (75, 3), (100, 4), (110, 5)]).collect()}
    assert got == {50: (True, 0), 75: (True, 2), 100: (True, 5), 110: (False, None)}


def log(spark, seconds, path):
    start = dt.datetime(2024, 1, 1)
    rows = [("r", start + dt.timedelta(seconds=s), 0.1 * (i + 1), i % 3 != 0) for i, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, "run STRING, ts TIMESTAMP, latency_s DOUBLE, ok BOOLEAN")
    df.coalesce(1).write.mode("append").parquet(path)
    return df


def test_windows_close_and_late_rows_are_dropped(spark, tmp_path):
    path = str(tmp_path / "in")
    first = log(spark, [0, 10, 20, 40, 300], path)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def go():
        stream = spark.readStream.schema(first.schema).parquet(path)
        windows = L.request_windows(stream, ["run"], "30 seconds", lateness="1 minute")
        windows.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out).orderBy("window_start").collect()

    rows = go()
    assert [(r.requests, r.failed) for r in rows] == [(3, 1), (1, 1)]
    assert rows[0].qps == pytest.approx(2 / 30) and rows[1].latency_p95 is None
    log(spark, [15, 600], path)
    assert [r.requests for r in go()] == [3, 1, 1]  # second 15 came too late, 300 is closed now
    exact = L.request_windows(first, ["run"], "30 seconds", exact=True).orderBy("window_start").first()
    assert exact.latency_p95 == pytest.approx(0.295)


def test_insert_outcomes(spark):
    df = spark.createDataFrame([("a", 10, True), ("a", 10, None), ("b", 10, True), ("b", 10, False)], "run STRING, rows BIGINT, ok BOOLEAN")
    got = {r.run: tuple(r)[1:] for r in L.insert_outcomes(df).collect()}
    assert got == {"a": (1, 1, 0, False, 10), "b": (1, 0, 1, True, 10)}


def test_a_repeated_id_counts_as_its_nearest_vector(spark, tmp_path):
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "qid BIGINT, emb ARRAY<FLOAT>")
    far, near = [(7, [9.0, 0.0])], [(7, [2.0, 0.0])]
    for metric, score in (("l2", 1.0), ("ip", 9.0)):
        for name, ticks in (("a", (far, near)), ("b", (near, far))):
            sink = L.IncrementalTopK(spark, str(tmp_path / f"{metric}-{name}"), queries, 3, metric)
            for i, rows in enumerate(ticks):
                sink(spark.createDataFrame(rows, "id BIGINT, emb ARRAY<FLOAT>"), i)
            assert [(r.id, r.score) for r in sink.hits().collect()] == [(7, score)]


def test_late_batches_write_only_rows_near_enough(spark, tmp_path):
    """A batch writes what may still be among the k nearest, and a restarted or repeated one ends in the same hits."""
    rng = np.random.default_rng(41)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1200)]
    queries = spark.createDataFrame([(i, rows[i][1]) for i in range(30)], "qid BIGINT, emb ARRAY<DOUBLE>")
    base = spark.createDataFrame(rows, "id BIGINT, emb ARRAY<DOUBLE>").cache()
    for metric in ("l2", "ip"):
        out = str(tmp_path / metric)
        for i in range(6):
            sink = L.IncrementalTopK(spark, out, queries, 5, metric)  # each batch by a new start
            for _ in range(1 + (i == 3)):
                sink(base.where(f"id >= {i * 200} and id < {(i + 1) * 200}"), i)
            want = nearest(base.where(f"id < {(i + 1) * 200}"), queries, 5, metric)
            assert sorted(map(tuple, sink.hits().collect())) == sorted(map(tuple, want.collect()))
        late = spark.read.parquet(f"{out}/v5").count()
        assert 0 < late < 30 * 5 / 2 and len(sink.versions()) < 6
