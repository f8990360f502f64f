import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import requests as Q
from nearfield.operators.quantiles import grouped_percentiles


def test_linear_percentiles(spark):
    log = spark.createDataFrame([("a", float(x)) for x in (1, 2, 4, 9)], "run STRING, latency_s DOUBLE")
    row = Q.latency_stats(log, ["run"]).first()
    assert (row.n, row.latency_avg, row.latency_p95, row.latency_p99) == (4, 4.0, 8.25, 8.85)


def test_large_groups_give_the_same_percentiles(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(x)) for x in np.round(rng.exponential(size=3000), 3)] + [("hot", 0.5)] * 2000
    rows += [("small", float(x)) for x in range(7)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE").repartition(5)
    parts = [0.0, 0.5, 0.95, 0.99, 1.0]
    exact = {r.g: r.p for r in grouped_percentiles(df, ["g"], "v", parts, [F.count("v").alias("n")]).collect()}
    cut = {r.g: r.p for r in grouped_percentiles(df, ["g"], "v", parts, [F.count("v").alias("n")], limit=0).collect()}
    for g in ("hot", "small", "one"):
        np.testing.assert_allclose(cut[g], exact[g], rtol=1e-12)
        np.testing.assert_allclose(exact[g], np.percentile([v for k, v in rows if k == g], [p * 100 for p in parts]), rtol=1e-12)
    assert cut["none"] is None


def test_sketch_rank_error(spark):
    values = np.random.default_rng(2).exponential(size=20_000)
    log = spark.createDataFrame([(i % 4, float(v)) for i, v in enumerate(values)], "worker INT, latency_s DOUBLE").withColumn("run", F.lit("r"))
    row = Q.sketch_stats(Q.latency_sketch(log, ["run", "worker"]), ["run"]).first()
    for value, p in ((row.latency_p95, 0.95), (row.latency_p99, 0.99)):
        assert abs((values <= value).mean() - p) < 0.01
    assert row.n == 20_000 and abs(row.latency_avg - values.mean()) < 1e-5
    assert spark.range(1).select(Q.latency_micros(F.lit(75.0))).first()[0] == 60_000_000


def test_unmeasured_requests_are_not_in_the_sketch(spark):
    log = spark.createDataFrame([("r", 1.0), ("r", None), ("r", None)], "run STRING, latency_s DOUBLE")
    row = Q.sketch_stats(Q.latency_sketch(log, ["run"]), ["run"]).first()
    assert (row.n, row.latency_avg, row.latency_p95, row.latency_p99) == (1, 1.0, 1.0, 1.0)


def test_workers_merge_conservatively(spark):
    stats = spark.createDataFrame([("r", 10, 1.0, 2.0, 3.0), ("r", 30, 2.0, 4.0, 2.5), ("r", 0, 9.0, 9.0, 9.0), ("idle", 0, 9.0, 9.0, 9.0)], "run STRING, n BIGINT, avg DOUBLE, p95 DOUBLE, p99 DOUBLE")
    rows = {r.run: (r.latency_p99, r.latency_p95, r.latency_avg) for r in Q.worker_merge(stats, ["run"]).collect()}
    assert rows == {"r": (3.0, 4.0, 1.75), "idle": (0.0, 0.0, 0.0)}


def stamp(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_levels_and_best_level(spark):
    rows = [("r", 5, stamp(i), 0.5, i % 4 != 0) for i in range(8)] + [("r", 10, stamp(100 + i / 2), 0.5, True) for i in range(8)] + [("dead", 5, stamp(0), 0.1, False)]
    log = spark.createDataFrame(rows, "run STRING, conc INT, ts TIMESTAMP, latency_s DOUBLE, ok BOOLEAN")
    levels = Q.qps_by_concurrency(log, ["run", "conc"])
    got = {(r.run, r.conc): (r.ok_count, r.failed_count, r.qps) for r in levels.collect()}
    assert got == {("r", 5): (6, 2, 0.8), ("r", 10): (8, 0, 2.0), ("dead", 5): (0, 1, 0.0)}
    best = {r.run: r for r in Q.max_qps(levels).collect()}
    assert (best["r"].max_qps, best["r"].best_conc, best["r"].conc_qps_list) == (2.0, 10, [0.8, 2.0])
    assert (best["dead"].max_qps, best["dead"].best_conc) == (0.0, None)
    rates = {(r.run, r.conc): (r.failed_rate, r.reported_rate) for r in Q.failed_rate(log).collect()}
    assert rates[("r", 5)] == (0.25, 0.0) and rates[("dead", 5)] == (1.0, 1.0)


def test_retries_fold_into_one_request(spark):
    rows = [(1, 0, 0.1, False), (1, 1, 0.2, True)] + [(2, a, 0.1, a == 6) for a in range(7)]
    log = spark.createDataFrame(rows, "request INT, attempt INT, latency_s DOUBLE, ok BOOLEAN").withColumn("ts", F.current_timestamp())
    got = {r.request: (round(r.latency_s, 6), r.attempts, r.ok) for r in Q.retry_fold(log, ["request"]).collect()}
    assert got == {1: (0.3, 2, True), 2: (0.6, 6, False)}


def test_cold_and_warm(spark):
    rows = [("r", p, i, v) for p, v in (("cold", 0.2), ("warm", 0.1)) for i in range(3)] + [("z", "cold", 0, 0.2), ("z", "warm", 0, 0.0)]
    out = {r.run: r for r in Q.cold_warm(spark.createDataFrame(rows, "run STRING, pass STRING, seq INT, latency_s DOUBLE"), ["run"]).collect()}
    r = out["r"]
    assert {r.cold_first_query, r.cold_p99, r.cold_p95, r.cold_avg} == {0.2} and {r.warm_first_query, r.warm_p99, r.warm_p95, r.warm_avg} == {0.1}
    assert {r.first_query_ratio, r.p99_ratio, r.p95_ratio, r.avg_ratio} == {2.0} and out["z"].avg_ratio == 0.0


def test_inserts_and_readiness(spark):
    log = spark.createDataFrame([("r", 100, stamp(0), True), ("r", 100, stamp(4), True), ("r", 50, stamp(2), False), ("one", 10, stamp(0), True)], "run STRING, rows BIGINT, ts TIMESTAMP, ok BOOLEAN")
    got = {r.run: (r.inserted_count, r.insert_rows_per_second, r.insert_completion_seconds) for r in Q.insert_throughput(log).collect()}
    assert got == {"r": (200, 50.0, 4.0), "one": (10, 10000.0, 0.0)}
    status = spark.createDataFrame([("r", stamp(5), False, False), ("r", stamp(6), True, False), ("r", stamp(9), True, True), ("one", stamp(1), True, False)], "run STRING, ts TIMESTAMP, searchable BOOLEAN, indexed BOOLEAN")
    end = log.groupBy("run").agg(F.max("ts").alias("end_ts"))
    got = {r.run: tuple(r)[1:] for r in Q.readiness_delays(status, end).collect()}
    assert got == {"r": (2.0, 3.0, False), "one": (1.0, None, True)}
    got = {r.run: tuple(r)[1:] for r in Q.readiness_delays(status, end, timeout_s=4).collect()}
    assert got["r"] == (2.0, None, True)


def test_capacity_counts_whole_passes(spark):
    rows = [("a", p, b, 10, not (p == 2 and b == 1)) for p in range(4) for b in range(3)] + [("b", 0, 0, 10, False), ("c", 0, 0, 10, True)]
    log = spark.createDataFrame(rows, "run STRING, load_pass INT, batch_id INT, rows BIGINT, ok BOOLEAN")
    assert {r.run: r.max_load_count for r in Q.max_load_count(log).collect()} == {"a": 60, "b": 0, "c": 10}


def test_percentiles_of_a_null_group_on_both_sides(spark):
    from nearfield.operators.quantiles import grouped_percentiles

    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 4.0), ("a", 8.0), ("a", None), ("b", None)], "k STRING, v DOUBLE")
    sides = [{r.k: r.p and list(r.p) for r in grouped_percentiles(df, ["k"], "v", [0.5], limit=limit).collect()} for limit in (100, 0)]
    assert sides[0][None] == sides[1][None] == [1.5] and sides[0]["a"] == sides[1]["a"] == [6.0]
