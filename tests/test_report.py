import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.plans import leaderboard as B
from nearfield.plans import report as G


def runs(spark, rows):
    return spark.createDataFrame(rows, "ord BIGINT, db_name STRING, case_name STRING, label STRING, qps DOUBLE")


def test_best_run_and_labels(spark):
    r = runs(spark, [(1, "a", "c", "x", 5.0), (2, "a", "c", ":)", 5.0), (3, "a", "c", "?", 1.0), (4, "b", "c", "x", 0.0), (5, "b", "c", "?", 0.0)])
    assert {x.db_name: x.ord for x in G.best_run(r).collect()} == {"a": 2, "b": 5}
    assert {x.db_name: x.label for x in G.label_merge(r).collect()} == {"a": ":)", "b": "?"}
    assert [(x.db_name, x.kind) for x in G.failed_tasks(r).collect()] == [("b", "timeout")]
    assert [x.db_name for x in G.merged_runs(r).collect()] == ["a"]
    row = G.failed_matrix(r, ["a", "b"]).first()
    assert (row.a, row.b) == (None, "?")


def test_frontier_equals_pairwise_check(spark):
    rng = np.random.default_rng(9)
    rows = [(i, f"s{i % 2}", float(rng.integers(90, 100)) / 100, float(rng.integers(1, 12))) for i in range(120)]
    points = spark.createDataFrame(rows, "ord BIGINT, db_name STRING, recall DOUBLE, qps DOUBLE").repartition(4)
    got = {r.ord: r.on_frontier for r in G.qps_recall_frontier(points).collect()}
    want = {o: all(q >= q2 for o2, d2, r2, q2 in rows if d2 == d and (r2, o2) > (r, o)) for o, d, r, q in rows}
    assert got == want


@pytest.mark.parametrize("lower", [False, True])
def test_score_equals_the_full_grid(spark, lower):
    rows = [("a", "c1", 100.0), ("a", "c2", 40.0), ("b", "c1", 50.0), ("b", "c2", 0.0), ("c", "c2", 80.0), ("d", "c1", None), ("d", "dead", 0.0)]
    values = {(d, c): v for d, c, v in rows if v}
    want = {}
    for d in "abcd":
        logs = []
        for c in ("c1", "c2"):
            mine = [v for (_, case), v in values.items() if case == c]
            v = values.get((d, c)) or (max(mine) * 2 if lower else min(mine) / 2)
            logs.append(np.log((min(mine) + 10) / (v + 10) * 100 if lower else v / max(mine) * 100))
        want[d] = np.exp(np.mean(logs))
    got = {r.db_name: r.score for r in B.score(spark.createDataFrame(rows, "db_name STRING, case_name STRING, value DOUBLE"), lower).collect()}
    assert got == pytest.approx(want)


def test_load_durations_are_carried(spark):
    rng = np.random.default_rng(3)
    rows = []
    for run in ("r", "s"):
        for i in range(60):
            key = None if rng.random() < 0.2 else f"k{rng.integers(3)}"
            rows.append((run, i, key, bool(rng.random() < 0.3), None if rng.random() < 0.2 else float(i)))
    want, latest = {}, {}
    for run, i, key, loads, dur in rows:
        out = dur
        if not loads and key is not None and latest.get(run, (None,))[0] == key:
            out = latest[run][1] or 0.0
        if loads and key is not None:
            latest[run] = (key, dur)
        want[(run, i)] = out
    df = spark.createDataFrame(rows, "run_id STRING, idx BIGINT, reuse_key STRING, loads BOOLEAN, load_duration DOUBLE").repartition(3)
    for chunk in (7, 1000):
        assert {(r.run_id, r.idx): r.load_duration for r in G.carry_load_duration(df, chunk=chunk).collect()} == want


def test_levels(spark):
    df = spark.createDataFrame([("a", [1, 5], [10.0], [0.1, 0.2], [], [0.1])], "db STRING, conc_num_list ARRAY<BIGINT>, conc_qps_list ARRAY<DOUBLE>, conc_latency_p99_list ARRAY<DOUBLE>, conc_latency_p95_list ARRAY<DOUBLE>, conc_latency_avg_list ARRAY<DOUBLE>")
    got = [tuple(r) for r in G.explode_concurrency(df, ["db"]).orderBy("conc_num").collect()]
    assert got == [("a", 1, 10.0, 100.0, 0.0, 100.0), ("a", 5, 0.0, 200.0, 0.0, 0.0)]
    pairs = df.select("db", F.col("conc_num_list").alias("concurrency"), F.col("conc_qps_list").alias("concurrent_qps"))
    with pytest.raises(Exception, match="differ in length"):
        G.explode_concurrency_strict(pairs, ["db"]).collect()


def test_final_pair_of_stages(spark):
    df = spark.createDataFrame([("a", s) for s in (50, 100, 110)] + [("b", s) for s in (50, 100)] + [("c", 110)], "db STRING, search_stage INT")
    got = {(r.db, r.search_stage): (r.normal, r.final_pair) for r in G.stage_split(df, ["db"]).collect()}
    assert got == {("a", 50): (True, False), ("a", 100): (True, True), ("a", 110): (False, True), ("b", 50): (True, False), ("b", 100): (True, False), ("c", 110): (False, False)}


def test_price_scalings(spark):
    r = spark.createDataFrame([("a", "l", 10.0), ("b", "l", 10.0), ("c", "l", 10.0)], "db STRING, db_label STRING, qps DOUBLE")
    prices = spark.createDataFrame([("a", "l", 2.0), ("b", "l", 0.0)], "db STRING, db_label STRING, price DOUBLE")
    assert [(x.db, x.qp_dollar) for x in B.queries_per_dollar(r, prices).collect()] == [("a", 18.0)]
    assert {x.db: x.qp_dollar for x in B.board_qp_dollar(r, prices).collect()} == {"a": 18000.0, "b": 0.0, "c": 0.0}


def test_backend_order(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", None)], "backend STRING, qps DOUBLE")
    assert [r.backend for r in G.backend_order(rows, "qps", False, ["z", "c", "a", "b"]).orderBy("position").collect()] == ["b", "a", "z", "c"]
    assert [r.backend for r in G.backend_order(rows, "qps", True, ["b", "a"]).orderBy("position").collect()] == ["a", "b"]
