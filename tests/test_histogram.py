import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import histogram as H


@pytest.mark.parametrize("bits", [0, 3, 10])
def test_bins_cover_their_values_in_order(spark, bits):
    values = sorted({0, 1, 2, 3, 59_999_999, 60_000_000, *(2**i + d for i in range(1, 26) for d in (-1, 0, 1))})
    df = spark.createDataFrame([(v,) for v in values], "v BIGINT").withColumn("bin", H.bin_of(F.col("v"), bits))
    rows = df.withColumn("top", H.top_of(F.col("bin"), bits)).withColumn("again", H.bin_of(F.col("top"), bits)).orderBy("v").collect()
    for r in rows:
        assert r.again == r.bin and 0 <= r.top - r.v <= max(r.v, 1) / 2**bits
        assert r.top == r.v or r.v >= 2 ** (bits + 1)
    assert [r.bin for r in rows] == sorted(r.bin for r in rows)


def test_percentiles_within_a_thousandth_and_histograms_add_up(spark):
    rng = np.random.default_rng(11)
    values = np.concatenate([rng.exponential(0.2, 4000), rng.exponential(9.0, 1000), [75.0, 0.0]])
    log = spark.createDataFrame([("hot", i % 3, float(v)) for i, v in enumerate(values)] + [("one", 0, 2.5), ("none", 0, None), ("below", 0, -1.0)], "run STRING, worker INT, latency_s DOUBLE")
    per_worker = H.histogram(log, ["run", "worker"])
    parts = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    found = {r.run: r for r in H.stats(per_worker, ["run"], parts).collect()}
    assert found == {r.run: r for r in H.stats(H.histogram(log, ["run"]), ["run"], parts).collect()}
    assert set(found) == {"hot", "one", "below"}
    us = np.sort(np.minimum((values * 1e6).astype(np.int64), 60_000_000))
    hot = found["hot"]
    assert hot.n == len(us) and abs(hot.latency_avg - us.mean() / 1e6) < 1e-9
    for name, p in parts.items():
        true = us[max(int(np.ceil(p * len(us))), 1) - 1] / 1e6
        assert true <= getattr(hot, name) <= true * 1.001
    assert found["one"].n == 1 and found["below"].p99 == 0.0
    assert H.histogram(log, ["run"]).where("run = 'hot'").count() < 17_500


def test_empty_log(spark):
    log = spark.createDataFrame([], "run STRING, latency_s DOUBLE")
    assert H.stats(H.histogram(log, ["run"]), ["run"], {"p95": 0.95}).count() == 0
