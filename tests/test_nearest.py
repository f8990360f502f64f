import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import nearest as N
from nearfield.operators.kernels import BitKernel, DenseKernel, RunningTopK, scan_block, thin_copies
from nearfield.operators.nearest import nearest


def brute(base, queries, k, metric):
    """(qid, rank, id, score) by full sort; base and queries are {id: vector}."""
    out = []
    for qid, q in queries.items():
        scored = []
        for i, b in base.items():
            if metric == "l2":
                d = np.linalg.norm(q - b)
            elif metric == "cos":
                lengths = np.linalg.norm(q) * np.linalg.norm(b)
                if lengths == 0:
                    continue
                d = 1 - q @ b / lengths
            else:
                d = -(q @ b)
            scored.append((round(float(d), 9) + 0.0, i))
        out += [(qid, r, i, d) for r, (d, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def frame(spark, vectors, name, parts=3):
    rows = [(i, v.tolist()) for i, v in vectors.items()]
    return spark.createDataFrame(rows, f"{name} BIGINT, emb ARRAY<FLOAT>").repartition(parts)


def found(df, metric):
    sign = -1 if metric == "ip" else 1
    return sorted((r.qid, r.rank, r.id, sign * r.score + 0.0) for r in df.collect())


def agree(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    np.testing.assert_allclose([g[3] for g in got], [w[3] for w in want], atol=2e-9)


def table(rng, n, dim, scale=1.0, first=0):
    return {first + i: (rng.normal(size=dim) * scale).astype(np.float32).astype(float) for i in range(n)}


@pytest.mark.parametrize("metric", ["l2", "cos", "ip"])
@pytest.mark.parametrize("query_bytes", [N.QUERY_BYTES, 0])
def test_equals_brute_force(spark, metric, query_bytes):
    rng = np.random.default_rng(3)
    base, queries = table(rng, 300, 12), table(rng, 17, 12, first=1000)
    hits = nearest(frame(spark, base, "id"), frame(spark, queries, "qid"), 7, metric, query_bytes=query_bytes)
    agree(found(hits, metric), brute(base, queries, 7, metric))


@pytest.mark.parametrize("query_bytes", [N.QUERY_BYTES, 0])
def test_copies_of_one_vector_are_ranked_by_id(spark, query_bytes):
    rng = np.random.default_rng(4)
    base = table(rng, 200, 8, scale=50.0)
    hot = base[7]
    base.update({500 + i: hot for i in range(150)})
    queries = {1: hot, 2: (hot * 1.01).astype(np.float32).astype(float), 3: -hot}
    hits = nearest(frame(spark, base, "id"), frame(spark, queries, "qid"), 20, "l2", query_bytes=query_bytes)
    agree(found(hits, "l2"), brute(base, queries, 20, "l2"))


def test_near_ties_far_from_the_origin(spark):
    rng = np.random.default_rng(5)
    far = np.full(16, 1000.0)
    base = {i: (far + rng.normal(size=16) * 1e-2).astype(np.float32).astype(float) for i in range(400)}
    queries = {i: (far + rng.normal(size=16) * 1e-2).astype(np.float32).astype(float) for i in range(5)}
    agree(found(nearest(frame(spark, base, "id"), frame(spark, queries, "qid"), 10, "l2"), "l2"), brute(base, queries, 10, "l2"))


@pytest.mark.parametrize("query_bytes", [N.QUERY_BYTES, 0])
def test_a_hot_key_and_slabs(spark, monkeypatch, query_bytes):
    monkeypatch.setattr(N, "SLAB_ROWS", 40)
    rng = np.random.default_rng(6)
    base, queries = table(rng, 300, 6), table(rng, 12, 6)
    keys = {i: ("hot" if i % 3 else f"k{i % 5}") for i in base}
    asked = {i: ("hot" if i % 2 else f"k{i % 5}") for i in queries}
    b = frame(spark, base, "id").join(spark.createDataFrame(list(keys.items()), "id BIGINT, tenant STRING"), "id")
    q = frame(spark, queries, "qid").join(spark.createDataFrame(list(asked.items()), "qid BIGINT, tenant STRING"), "qid")
    want = []
    for qid, v in queries.items():
        want += brute({i: x for i, x in base.items() if keys[i] == asked[qid]}, {qid: v}, 5, "l2")
    agree(found(nearest(b, q, 5, "l2", key="tenant", query_bytes=query_bytes), "l2"), sorted(want))


@pytest.mark.parametrize("query_bytes", [N.QUERY_BYTES, 0])
def test_edges(spark, query_bytes):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (None, [1.0, 1.0])], "id BIGINT, emb ARRAY<FLOAT>")
    queries = spark.createDataFrame([(5, [1.0, 1.0]), (6, None)], "qid BIGINT, emb ARRAY<FLOAT>")
    assert [(r.qid, r.id) for r in nearest(base, queries, 10, "cos", query_bytes=query_bytes).collect()] == [(5, 1)]
    assert sorted((r.qid, r.id) for r in nearest(base, queries, 10, "l2", query_bytes=query_bytes).collect()) == [(5, 1), (5, 3)]
    assert nearest(base, queries.where("false"), 3, query_bytes=query_bytes).count() == 0
    assert nearest(base.where("false"), queries, 3, query_bytes=query_bytes).count() == 0


def test_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "v")
    frame(spark, table(np.random.default_rng(7), 50, 4), "id").withColumn("label", F.col("id") % 5).write.parquet(path)
    hits = nearest(spark.read.parquet(path).where("label = 3"), frame(spark, table(np.random.default_rng(8), 3, 4), "qid"), 2)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("metric", ["l2", "cos", "ip"])
def test_a_crowd_of_copies_in_one_block(metric):
    rng = np.random.default_rng(12)
    rows = rng.normal(size=(4000, 8))
    rows[500:2500] = rows[500]
    rows[100] = 0.0
    ids = rng.permutation(4000)
    queries = np.vstack([rows[500], rng.normal(size=(6, 8))])
    state = RunningTopK(len(queries), 15)
    for lo in range(0, 4000, 1500):
        scan_block(DenseKernel(metric, queries), state, np.arange(len(queries)), ids[lo : lo + 1500], rows[lo : lo + 1500])
    got = [(q, 0, i, d) for q, i, d in zip(state.q, state.ids, state.d)]
    want = brute(dict(zip(ids, rows)), dict(enumerate(queries)), 15, metric)
    assert [(g[0], g[2]) for g in got] == [(w[0], w[2]) for w in want]
    kept, _ = thin_copies(ids, rows, 15)
    assert len(kept) == 2000 + 15


def test_crowded_bits():
    rng = np.random.default_rng(13)
    rows, queries = rng.integers(0, 4, size=(3000, 2)), rng.integers(0, 4, size=(5, 2))
    state = RunningTopK(5, 10)
    scan_block(BitKernel("hamming", queries), state, np.arange(5), np.arange(3000), rows)
    for q in range(5):
        d = [bin(int(a) ^ int(b)).count("1") + bin(int(c) ^ int(e)).count("1") for (a, c), (b, e) in zip(rows, [queries[q]] * 3000)]
        assert state.ids[state.q == q].tolist() == sorted(range(3000), key=lambda i: (d[i], i))[:10]


def test_both_query_paths_agree_on_odd_input(spark):
    """Repeated query ids, tiny distances and 32-bit ids give the same rows and schema with and without a broadcast."""
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 3e-10]), (3, [1.0, 1e-10]), (4, [1.0, 2e-10]), (5, [0.0, 5.0])], "id INT, emb ARRAY<DOUBLE>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [9.0, 0.0]), (8, [0.0, 4.0])], "qid INT, emb ARRAY<DOUBLE>")
    one, two = (nearest(base, asked, 4, "l2", query_bytes=size) for size in (1 << 28, 0))
    assert one.schema == two.schema
    rows = sorted(map(tuple, one.collect()))
    assert rows == sorted(map(tuple, two.collect()))
    assert [r[2] for r in rows if r[0] == 7] == [1, 3, 4, 2]


def test_ragged_vectors_and_text_ids_are_errors(spark):
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid BIGINT, emb ARRAY<DOUBLE>")
    ragged = spark.createDataFrame([(1, [1.0, 2.0]), (77, [1.0, 2.0, 3.0, 4.0]), (3, [1.0, 2.0])], "id BIGINT, emb ARRAY<DOUBLE>").coalesce(1)
    with pytest.raises(Exception, match="id 77 has 4 components"):
        nearest(ragged, asked, 2).collect()
    with pytest.raises(TypeError, match="whole-number"):
        nearest(ragged.withColumn("id", F.col("id").cast("string")), asked, 2)


def test_sweep_takes_any_64_bit_query_id(spark):
    from nearfield.operators import ann

    base = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id BIGINT, emb ARRAY<DOUBLE>")
    big = (1 << 62) + 1
    asked = spark.createDataFrame([(big, [3.2, 1.0]), (-big, [17.9, 1.0])], "qid BIGINT, emb ARRAY<DOUBLE>")
    centres = np.array([[5.0, 1.0], [15.0, 1.0]])
    rows = ann.sweep_nprobe(base, asked, 1, centres, [1, 2]).collect()
    assert {(r.nprobe, r.qid, r.id) for r in rows} == {(n, q, i) for n in (1, 2) for q, i in ((big, 3), (-big, 18))}


def test_a_registered_measure_is_searched_by_name(spark):
    from nearfield.functions.vector import register_metric

    def spread(a, b):
        return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))

    rng = np.random.default_rng(8)
    base = {i: np.round(rng.normal(size=6), 1).astype(np.float32).astype(float) for i in range(300)}
    queries = {i: base[i] for i in range(0, 300, 29)}
    b = spark.createDataFrame([(i, v.tolist()) for i, v in base.items()], "id BIGINT, emb ARRAY<FLOAT>").repartition(3)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in queries.items()], "qid BIGINT, emb ARRAY<FLOAT>")
    register_metric("chebyshev", spread, block=lambda a, b: np.abs(a - b).max(axis=-1))
    register_metric("closeness", lambda a, b: -spread(a, b), lower_is_nearer=False, block=lambda a, b: -np.abs(a - b).max(axis=-1))
    register_metric("unblocked", spread)
    want = sorted((i, r, j, d) for i, v in queries.items() for r, (d, j) in enumerate(sorted((round(float(np.abs(v - o).max()), 9), j) for j, o in base.items())[:5]))
    for path in (None, 0):
        extra = {} if path is None else {"query_bytes": path}
        assert sorted(tuple(r) for r in nearest(b, q, 5, "chebyshev", **extra).collect()) == want
        assert sorted(tuple(r) for r in nearest(b, q, 5, "closeness", **extra).collect()) == [(i, r, j, -d + 0.0) for i, r, j, d in want]
    with pytest.raises(ValueError, match="without a block form"):
        nearest(b, q, 5, "unblocked")
    with pytest.raises(ValueError, match="unknown metric"):
        nearest(b, q, 5, "nothing")
    with pytest.raises(ValueError, match="built-in"):
        register_metric("l2", spread)


@pytest.mark.parametrize("metric", ["l2", "cos", "ip", "hamming", "jaccard"])
def test_tiles_of_any_size_give_the_same(metric, monkeypatch):
    """Queries and rows that fill several tiles, with copies and ties, against a full sort."""
    from nearfield.operators import kernels as K

    monkeypatch.setattr(K, "_TILE_CELLS", 600)
    monkeypatch.setattr(K, "_TILE_ROWS", 37)
    rng = np.random.default_rng(21)
    bits = metric in ("hamming", "jaccard")
    rows = rng.integers(0, 8, size=(500, 3)) if bits else rng.normal(size=(500, 5)).astype(np.float32)
    rows[300:400] = rows[:100]
    queries, ids = rows[::9], rng.permutation(500)
    kernel = BitKernel(metric, queries) if bits else DenseKernel(metric, queries)
    state = RunningTopK(len(queries), 6)
    for lo in range(0, 500, 90):
        scan_block(kernel, state, np.arange(len(queries)), ids[lo : lo + 90], rows[lo : lo + 90])
    for q in range(len(queries)):
        exact = kernel.rows(ids, rows).exact
        d = kernel.settled(kernel.exact(np.full(500, q), exact))
        best = np.lexsort((ids, d))[:6]
        assert state.ids[state.q == q].tolist() == ids[best].tolist()
        np.testing.assert_allclose(state.d[state.q == q], d[best], atol=1e-12)


def test_kernels_hold_no_copies_of_the_queries_and_bound_what_a_function_gets():
    from nearfield.operators.kernels import FunctionKernel, ProductKernel

    rng = np.random.default_rng(22)
    queries, rows = rng.normal(size=(3000, 16)).astype(np.float32), rng.normal(size=(3000, 16)).astype(np.float32)
    codes = ProductKernel(rng.normal(size=(4, 16, 4)), queries)
    for kernel in (DenseKernel("cos", queries), codes):
        held = sum(v.nbytes for v in vars(kernel).values() if isinstance(v, np.ndarray) and v is not kernel.raw)
        assert np.shares_memory(kernel.raw, queries) and held < queries.nbytes / 2
    sizes = []

    def block(a, b):
        sizes.append(np.broadcast(a, b).size)
        return np.abs(a - b).sum(axis=-1)

    state = RunningTopK(100, 3)
    scan_block(FunctionKernel(block, 1, queries[:100], single=1e-5), state, np.arange(100), np.arange(3000), rows)
    assert max(sizes) <= 1 << 19
    d = np.abs(queries[:100, None, :].astype(float) - rows[None]).sum(axis=-1)
    assert state.ids.reshape(100, 3).tolist() == np.argsort(d, axis=1, kind="stable")[:, :3].tolist()


def test_queries_beyond_the_budget_meet_the_base_without_a_join(spark, monkeypatch):
    """Each task owns some queries, all base rows stream past it, and what it returns is final."""
    rng = np.random.default_rng(23)
    base, queries = table(rng, 700, 6), table(rng, 400, 6)
    b, q = frame(spark, base, "id"), frame(spark, queries, "qid")
    hits = nearest(b, q, 4, "l2", query_bytes=0)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    agree(found(hits, "l2"), brute(base, queries, 4, "l2"))
    monkeypatch.setattr(N, "PARTIAL_HITS", 40)
    agree(found(nearest(b, q, 4, "l2"), "l2"), brute(base, queries, 4, "l2"))


@pytest.mark.parametrize("query_bytes", [N.QUERY_BYTES, 0])
def test_many_keys_and_hot_ones_on_either_side(spark, query_bytes):
    rng = np.random.default_rng(24)
    base, queries = table(rng, 900, 4), table(rng, 600, 4)
    keys, asked = {i: i % 90 if i % 3 else 7 for i in base}, {i: i % 100 if i % 2 else 7 for i in queries}
    b = frame(spark, base, "id").join(spark.createDataFrame(list(keys.items()), "id BIGINT, tenant INT"), "id")
    q = frame(spark, queries, "qid").join(spark.createDataFrame(list(asked.items()), "qid BIGINT, tenant INT"), "qid")
    want = []
    for qid, v in queries.items():
        want += brute({i: x for i, x in base.items() if keys[i] == asked[qid]}, {qid: v}, 5, "cos")
    agree(found(nearest(b, q, 5, "cos", key="tenant", query_bytes=query_bytes), "cos"), sorted(want))


@pytest.mark.parametrize("query_bytes", [N.QUERY_BYTES, 0])
def test_an_array_of_keys_is_a_row_per_key(spark, query_bytes):
    rng = np.random.default_rng(25)
    base, queries = table(rng, 200, 4), table(rng, 20, 4)
    b = frame(spark, base, "id").withColumn("list", F.col("id") % 5)
    q = frame(spark, queries, "qid").withColumn("list", F.expr("array(qid % 5, null, (qid + 2) % 5, qid % 5)"))
    one = nearest(b, q, 6, "l2", key="list", query_bytes=query_bytes)
    two = nearest(b, q.withColumn("list", F.explode("list")), 6, "l2", key="list", query_bytes=query_bytes)
    assert one.count() == 120 and found(one, "l2") == found(two, "l2")


@pytest.mark.parametrize("query_bytes", [N.QUERY_BYTES, 0])
def test_fetched_rows_are_measured_where_they_are_read(spark, query_bytes):
    from nearfield.operators import ann as A
    from nearfield.operators.nearest import nearest_refined

    rng = np.random.default_rng(26)
    base, queries = table(rng, 400, 33), table(rng, 50, 33)
    b, q = frame(spark, base, "id"), frame(spark, queries, "qid")
    both = nearest_refined(A._with_bits(b), A._with_bits(q), 5, [10, 30], "cos", query_bytes=query_bytes)
    for cut in (10, 30):
        want = A.rerank(A.knn_binary(b, q, cut), b, q, 5, cut, "cos")
        assert found(both.where(F.col("cut") == cut), "cos") == found(want, "cos")
    twice = b.unionByName(b)
    assert found(A.knn_rerank(twice, q, 5, 2), "cos") == found(A.rerank(A.knn_binary(twice, q, 10), twice, q, 5, 10, "cos"), "cos")
