"""Trained centres and codebooks: against plain numpy, and what a trained index finds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import lloyd as L
from nearfield.operators.index import probe_curve, probes_for, search_index, write_index
from nearfield.operators.nearest import nearest
from nearfield.operators.quantize import ProductCodec


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 12)) * 4
    rows = [(i, (centres[i % 9] + rng.normal(size=12) * 0.5).tolist()) for i in range(900)]
    return spark.createDataFrame([*rows, (5000, None), (5001, [])], "id BIGINT, emb ARRAY<FLOAT>").repartition(4).cache()


def numbers(df):
    return np.array([r.emb for r in df.where("size(emb) > 0").orderBy("id").collect()], dtype=np.float64)


def test_one_iteration_against_numpy(clusters):
    rows, rng = numbers(clusters), np.random.default_rng(0)
    books = rng.normal(size=(3, 7, 4)) * 4
    books[1, 6] = 1e6  # near to nothing
    means, counts, loss = L._iteration(clusters.where("size(emb) > 0").select("emb"), books)
    total = 0.0
    for m in range(3):
        piece = rows[:, 4 * m : 4 * m + 4]
        d = ((piece[:, None, :] - books[m][None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        total += d.min(axis=1).sum()
        for c in range(7):
            assert counts[m, c] == (own == c).sum()
            if counts[m, c]:
                assert np.allclose(means[m, c], piece[own == c].mean(axis=0), atol=1e-9)
    assert counts[1, 6] == 0 and loss == pytest.approx(total, rel=1e-9)


def test_training_finds_the_clusters(clusters):
    book = L.train_codes(clusters, 1, 9, seed=2)[0]
    rows = numbers(clusters)
    gap = np.sqrt(((rows[:, None, :] - book[None]) ** 2).sum(axis=2)).min(axis=1)
    assert gap.mean() < 2.2  # about the spread inside a cluster
    again = L.train_codes(clusters.repartition(7), 1, 9, seed=2)[0]
    assert np.allclose(book, again, atol=1e-9)
    few = L.train_codes(clusters, 1, 9, seed=2, train_rows=300)[0]
    assert few.shape == (9, 12) and not np.allclose(few, book)


def test_copies_do_not_crowd_out_the_rest(spark):
    rows = [(i, [0.0, 0.0]) for i in range(3000)] + [(9000 + i, [float(i % 4), 9.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "id BIGINT, emb ARRAY<DOUBLE>").repartition(5)
    book = L.train_codes(df, 1, 5)[0]
    assert sorted({tuple(np.round(c, 9)) for c in book}) == [(0.0, 0.0), *[(float(i), 9.0) for i in range(4)]]
    same = L.train_codes(df.where("id < 3000"), 1, 4)[0]
    assert same.shape == (4, 2) and not same.any()


def test_what_cannot_be_trained(spark, clusters):
    with pytest.raises(ValueError, match="cannot be cut"):
        L.train_codes(clusters, 5, 4)
    with pytest.raises(ValueError, match="no vectors"):
        L.train_codes(clusters.where("id >= 5000"), 1, 4)


def test_a_trained_index(spark, clusters, tmp_path):
    base = clusters.where("size(emb) > 0")
    asked = base.where("id % 30 = 0").select(F.col("id").alias("qid"), "emb")
    truth = nearest(base, asked, 10, "l2").select("qid", "id")
    index = write_index(base, str(tmp_path / "index"), L.train_codes(base, 1, 9)[0], product=ProductCodec.train(base, 4, bits=5))
    curve = {r.nprobe: r.found for r in probe_curve(index, asked, truth).collect()}
    for nprobe in (1, 3):
        hits = search_index(index, asked, 10, nprobe).select("qid", "id")
        assert hits.intersect(truth).count() == max(n for p, n in curve.items() if p <= nprobe)
    assert max(curve.values()) == asked.count() * 10
    nprobe = probes_for(index, asked, truth, 0.95)
    assert nprobe < 9
    hits = search_index(index, asked, 10, nprobe, "pq", refine=8).select("qid", "id")
    assert hits.intersect(truth).count() >= 0.9 * asked.count() * 10
    assert probes_for(index, asked.where("false"), truth, 0.95) == 1
