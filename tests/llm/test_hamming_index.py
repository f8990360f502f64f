import numpy as np
from pyspark.sql import functions as F

from nearfield.llm import hamming_index as H


def brute(rows, k):
    good = [(i, v) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, matrix = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = {}
    for q in sorted(set(ids[ids % 10 == 0])):
        own = min(v for i, v in good if i == q)
        far = np.sqrt(((matrix - own) ** 2).sum(1))
        best = {}
        for i, d in zip(ids, far):
            if i != q:
                best[i] = min(d, best.get(i, np.inf))
        out[int(q)] = sorted((float(d), int(i)) for i, d in best.items())[:k]
    return out


def test_recall_order_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(1, 600)]
    rows += [(i, [0.5] * 16) for i in range(700, 760)]  # a crowd of equal vectors
    rows += [(30, rows[0][1]), (30, rows[0][1]), (None, rows[1][1]), (801, None), (802, []), (803, [0.0] * 16), (804, [None] + [1.0] * 15), (805, [float("nan")] * 16), (806, [float("inf")] * 16), (807, [1.0] * 3)]
    table = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>").withColumn("id", F.lit("x")).withColumn("v", F.lit("x")).repartition(4)
    got = {}
    for r in H.search(table, F.col("id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.id))
    true = brute(rows, 10)
    assert set(got) == set(true)
    assert all(g == sorted(g) and len(g) == 10 for g in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in true[q]}) for q in true)
    assert hits >= 0.9 * 10 * len(true)
    assert all(dict((i, d) for d, i in true[q]).get(i, d) == d for q in true for d, i in got[q])
    assert [i for _, i in got[700]] == list(range(701, 711))


def test_few_rows_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [-5.0, 1.0]), (2, [3.0, -4.0])], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    rows = H.search(table, F.col("id") == 0).collect()
    assert [(r["rank"], r.id) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert H.search(table.where("false"), F.col("id") == 0).count() == 0
    assert H.search(table, F.col("id") == 99).count() == 0


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (3000, 3)).astype(np.uint16)
    codes[:200] = codes[0] ^ (1 << rng.integers(0, 16, (200, 3))).astype(np.uint16)
    orders = np.argsort(codes, axis=0, kind="stable").astype(np.int32).T
    row = {"n": 3000, "ids": np.arange(3000).tobytes(), "vectors": np.zeros((3000, 1)).tobytes(), "codes": codes.tobytes(), "orders": np.ascontiguousarray(orders).tobytes()}
    chunk = H.Chunk(row, "<f8")
    for radius in (0, 1, 5, 13, 20):
        assert chunk.probe(codes[0], radius).tolist() == np.flatnonzero(H.apart(codes, codes[0]) <= radius).tolist()
