import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import ann as A
from nearfield.operators import evaluate as E
from nearfield.operators.nearest import nearest
from nearfield.operators.quantize import ProductCodec, ScalarCodec, first_vectors, train_centroids
from nearfield.operators.truth import build_ground_truth, explode_truth, neighbor_lists, truth_filters


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 16)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=16)).tolist()) for i in range(400)]
    base = spark.createDataFrame(rows, "id BIGINT, emb ARRAY<FLOAT>").repartition(3).cache()
    queries = base.where("id % 20 = 0").select(F.col("id").alias("qid"), "emb").cache()
    truth = nearest(base, queries, 10, "l2").select("qid", F.col("rank").alias("gt_rank"), "id").cache()
    return base, queries, truth


def mean_recall(hits, truth, k=10):
    return E.score_hits(hits, truth, k).agg(F.avg("recall")).first()[0]


def test_all_lists_probed_is_exact(data):
    base, queries, truth = data
    cent = train_centroids(base, 5, seed=1)
    assert mean_recall(A.knn_ivf_flat(base, queries, 10, cent, 5), truth) == 1.0


def test_recall_grows_with_nprobe_and_oversample(data):
    base, queries, truth = data
    cent = first_vectors(base, 8)
    swept = A.sweep_nprobe(base, queries, 10, cent, [1, 2, 8]).cache()
    by_probe = [mean_recall(swept.where(F.col("nprobe") == p), truth) for p in (1, 2, 8)]
    assert by_probe == sorted(by_probe) and by_probe[-1] == 1.0
    alone = sorted(tuple(r) for r in A.knn_ivf_flat(base, queries, 10, cent, 2).select("qid", "rank", "id").collect())
    assert alone == sorted(tuple(r) for r in swept.where("nprobe = 2").select("qid", "rank", "id").collect())
    by_fetch = [mean_recall(A.knn_rerank(base, queries, 10, o, "l2"), truth) for o in (1, 4, 40)]
    assert by_fetch == sorted(by_fetch) and by_fetch[-1] == 1.0


def test_a_grid_gives_what_each_search_gives(data):
    base, queries, truth = data
    cent = first_vectors(base, 8)
    listed = A.assign_lists(base, cent)
    grid = A.sweep_grid(listed, queries, 10, cent, [2, 8], [1, 6]).cache()
    for nprobe, oversample in ((2, 1), (2, 6), (8, 1), (8, 6)):
        alone = A.knn_ivf_bq(listed, queries, 10, cent, nprobe, oversample).collect()
        mine = grid.where((F.col("nprobe") == nprobe) & (F.col("oversample") == oversample))
        assert sorted((r.qid, r["rank"], r.id, r.score) for r in mine.collect()) == sorted((r.qid, r["rank"], r.id, r.score) for r in alone)
    cost = {(r.nprobe, r.oversample): r for r in A.grid_cost(listed, A.probe_lists(queries, cent, 8), [2, 8], [1, 6], 10).collect()}
    assert cost[8, 1].rows_scanned == 400 * 20 and cost[8, 6].rows_refined == 60 * 20 and cost[2, 1].rows_refined <= 10 * 20


def test_trained_codes_find_most_neighbours(data):
    base, queries, truth = data
    cent = first_vectors(base, 4)
    assert mean_recall(A.knn_ivf_sq8(base, queries, 10, cent, 4, ScalarCodec.fit(base)), truth) > 0.9
    codec = ProductCodec.train(base, parts=4, bits=4)
    assert codec.codebooks.shape == (4, 16, 4)
    assert mean_recall(A.knn_ivf_pq(base, queries, 10, cent, 4, codec), truth) > 0.3
    assert mean_recall(A.knn_ivf_bq(base, queries, 10, cent, 4, 40), truth) == 1.0


def test_truth_tables_per_filter(data):
    base, queries, _ = data
    names = truth_filters(400, [0.5], {0.1: F.col("id") % 10 == 3})
    truth = build_ground_truth(base, queries, 5, names, "l2")
    kept = {r.filter_key: (r.n, r.lo) for r in truth.groupBy("filter_key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo")).collect()}
    assert set(kept) == {"neighbors", "neighbors_int_50p", "neighbors_labels_label_10p"}
    assert all(n == 20 * 5 for n, _ in kept.values()) and kept["neighbors_int_50p"][1] >= 200
    lists = neighbor_lists(nearest(base, queries, 5, "l2"))
    assert explode_truth(lists).count() == 100


def test_a_stored_index_reads_probed_lists_only(spark, tmp_path):
    from nearfield.operators.index import search_index, write_index
    from nearfield.operators.nearest import nearest
    from nearfield.operators.quantize import ScalarCodec

    rng = np.random.default_rng(0)
    base = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)] + [(900, [0.0] * 8), (901, None)], "id BIGINT, emb ARRAY<DOUBLE>")
    asked = base.where("id < 20").withColumnRenamed("id", "qid")
    centres = rng.normal(size=(6, 8))
    for metric in ("l2", "cos", "ip"):
        index = write_index(base, str(tmp_path / metric), centres, metric, scalar=ScalarCodec.fit(base))
        every = search_index(index, asked, 5, 6, refine=2)
        exact = nearest(base, asked, 5, metric)
        assert sorted((r.qid, r["rank"], r.id) for r in every.collect()) == sorted((r.qid, r["rank"], r.id) for r in exact.collect())
        assert search_index(index, asked, 5, 1, "sq", refine=2).count() > 0
    some = search_index(index, asked.limit(1), 5, 1)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list_id" in plan.split("PartitionFilters")[1][:80]


def test_sweeps_search_each_setting_and_not_each_list(data, monkeypatch):
    """The rows that a sweep keeps grow with the settings of its grid, not with the probed lists."""
    from nearfield.operators import nearest as N

    base, queries, _ = data
    cent, asked = first_vectors(base, 8), []
    scan = N._search
    monkeypatch.setattr(N, "_search", lambda base, queries, *rest: asked.append(queries.count()) or scan(base, queries, *rest))
    assert A.sweep_nprobe(base, queries, 10, cent, [1, 8]).count() > 0
    assert A.sweep_grid(base, queries, 10, cent, [2, 8], [1, 6]).count() > 0
    assert asked == [2 * 20, 2 * 20]


def test_all_lists_of_a_stored_index_are_not_searched_list_by_list(spark, tmp_path):
    from nearfield.operators.index import search_index, write_index

    rng = np.random.default_rng(31)
    base = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(200)], "id BIGINT, emb ARRAY<DOUBLE>")
    asked = base.where("id < 30").withColumnRenamed("id", "qid")
    index = write_index(base, str(tmp_path / "index"), rng.normal(size=(40, 8)), "cos", scalar=ScalarCodec.fit(base), product=ProductCodec.train(base, 4, 4))
    hits = search_index(index, asked, 5, 40)
    assert "PartitionFilters: []" in hits._jdf.queryExecution().executedPlan().toString()
    want = sorted((r.qid, r["rank"], r.id) for r in nearest(base, asked, 5, "cos").collect())
    assert sorted((r.qid, r["rank"], r.id) for r in hits.collect()) == want
    for kind in ("sq", "pq", "bits"):  # measured where they are read: no vector is fetched by id
        fine = search_index(index, asked, 5, 7, kind, refine=40)
        assert "Join" not in fine._jdf.queryExecution().optimizedPlan().toString()
        flat = search_index(index, asked, 5, 7)
        assert sorted(map(tuple, fine.collect())) == sorted(map(tuple, flat.collect()))
