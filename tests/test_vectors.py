import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import labels as L
from nearfield.functions import vector as V
from nearfield.operators.quantize import ScalarCodec, reduce_precision
from nearfield.sources.tables import shard_names


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(20, 40)), rng.normal(size=(20, 40))
    rows = [(i, a[i].tolist(), b[i].tolist()) for i in range(20)]
    return a, b, spark.createDataFrame(rows, "id INT, a ARRAY<FLOAT>, b ARRAY<FLOAT>")


def column(df, expr):
    return np.array([r[0] for r in df.orderBy("id").select(expr).collect()], dtype=float)


def test_distances_agree_with_numpy(pairs):
    a, b, df = pairs
    a, b = a.astype(np.float32).astype(float), b.astype(np.float32).astype(float)
    np.testing.assert_allclose(column(df, V.inner_product("a", "b")), (a * b).sum(1), rtol=1e-12)
    np.testing.assert_allclose(column(df, V.l2_distance("a", "b")), np.linalg.norm(a - b, axis=1), rtol=1e-12)
    cos = 1 - (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
    np.testing.assert_allclose(column(df, V.cosine_distance("a", "b")), cos, rtol=1e-10)
    differ = ((a > 0) != (b > 0)).sum(1)
    bits = [V.binary_quantize(c) for c in ("a", "b")]
    np.testing.assert_array_equal(column(df, V.hamming_distance(*bits)), differ)
    both, either = ((a > 0) & (b > 0)).sum(1), ((a > 0) | (b > 0)).sum(1)
    np.testing.assert_allclose(column(df, V.jaccard_distance(*bits)), 1 - both / either)


def test_zero_and_empty_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    none = F.expr("cast(array(0L) as array<bigint>)")
    row = df.select(V.l2_normalize("a"), V.cosine_distance("a", "b"), V.jaccard_distance(none, none), F.size(V.binary_quantize(F.expr("cast(array() as array<float>)")))).first()
    assert row[0] is None and row[1] is None and row[2] == 0.0 and row[3] == 0


def test_metric_registry():
    V.register_metric("manhattan", lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x))
    assert V.metric("manhattan")[1] is True
    with pytest.raises(ValueError):
        V.metric("nothing")


@pytest.mark.parametrize("kind,steps", [("SQ8", 255), ("SQ6", 63), ("SQ4U", 15)])
def test_scalar_codes_stay_within_half_a_step(spark, pairs, kind, steps):
    a, _, df = pairs
    base = df.select("id", F.col("a").alias("emb"))
    codec = ScalarCodec.fit(base, kind)
    back = base.orderBy("id").select(codec.encode(F.col("emb")).alias("c")).select("c", codec.decode(F.col("c")).alias("v")).collect()
    codes, values = np.array([r["c"] for r in back]), np.array([r["v"] for r in back])
    assert codes.min() >= 0 and codes.max() == steps
    assert (np.abs(values - a.astype(np.float32)) <= (codec.hi - codec.lo) / steps / 2 + 1e-9).all()


def test_reduced_precision(spark, pairs):
    a, _, df = pairs
    a = a.astype(np.float32)
    rows = df.orderBy("id").select(reduce_precision(F.col("a"), "FP16"), reduce_precision(F.col("a"), "BF16")).collect()
    np.testing.assert_array_equal(np.array([r[0] for r in rows], dtype=np.float32), a.astype(np.float16).astype(np.float32))
    np.testing.assert_array_equal(np.array([r[1] for r in rows], dtype=np.float32), (a.view(np.uint32) & 0xFFFF0000).view(np.float32))


def test_names_and_sizes(spark):
    ids = spark.createDataFrame([(3,), (11,), (26,), (1240,)], "id BIGINT")
    got = ids.orderBy("id").select("id", L.tenant_for_id(F.col("id"), 5, "t", 3).alias("tenant")).collect()
    assert [r.tenant for r in got] == [f"t{r.id % 5:03}" for r in got]
    cases = [(p, k, d) for p in ("ids_only", "vector", "text", "scalar_label") for k in (1, 6, 25) for d in (3, 48)]
    each = {"ids_only": lambda d: L.HIT_BYTES, "vector": lambda d: L.HIT_BYTES + d * L.DIM_BYTES, "text": lambda d: L.HIT_BYTES + L.TEXT_BYTES, "scalar_label": lambda d: L.HIT_BYTES + L.LABEL_BYTES}
    sizes = spark.createDataFrame([(p, k, d, k * each[p](d)) for p, k, d in cases], "p STRING, k INT, d INT, want BIGINT")
    assert sizes.where(L.payload_bytes(F.col("p"), F.col("k"), F.col("d")) != F.col("want")).count() == 0
    rates = spark.createDataFrame([(0.01, "int_1p"), (0.5, "int_50p"), (0.995, "int_99.5p"), (0.001, "int_0.1p")], "r DOUBLE, want STRING")
    assert rates.where(L.int_rate(F.col("r")) != F.col("want")).count() == 0
    assert L.int_truth_table(0.995) == "neighbors_int_99.5p" and L.label_truth_table(0.001) == "neighbors_labels_label_0.1p"


@pytest.mark.parametrize("n", [2, 9, 37])
def test_shard_names(n):
    for shuffled, stem in ((True, "shuffle_train"), (False, "train")):
        names = shard_names(n, shuffled=shuffled)
        assert names == sorted(set(names)) and len(names) == n
        assert all(name.split("-")[0] == stem and name.endswith(f"-of-{n}.parquet") for name in names)
    assert shard_names(1) == ["train.parquet"]
