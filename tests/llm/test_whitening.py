"""The incremental decomposition against a dense one, and the whitened rows against their definition."""

import math

import numpy as np
import pytest

from nearfield.llm import queries, whitening as W

SF = "/root/testdata/sf0.01"
RNG = np.random.default_rng(11)
CASES = {
    "plain": RNG.normal(size=(400, 16)),
    "fewer rows than dimensions": RNG.normal(size=(5, 16)),
    "copies": np.repeat(RNG.normal(size=(3, 8)), 60, axis=0),
    "no variance": np.ones((30, 4)),
    "equal eigenvalues": np.vstack([np.eye(6), -np.eye(6)] * 10),
    "unequal scales": RNG.normal(size=(300, 12)) * 10.0 ** np.arange(-6, 6),
    "whole numbers": np.floor(8 * RNG.normal(size=(300, 64))),
    "one direction": np.outer(RNG.normal(size=90), RNG.normal(size=7)),
    "one dimension": RNG.normal(size=(40, 1)),
    "zeros and ones": RNG.integers(0, 2, (200, 5)).astype(float),
}


def scatter(rows):
    gap = rows - rows.mean(axis=0)
    return gap.T @ gap


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("block", [1, 7, 4096])
def test_spectrum_of_a_task(name, block):
    rows = CASES[name]
    s, other = W.Spectrum.empty(rows.shape[1]), W.Spectrum.empty(rows.shape[1])
    for start in range(0, len(rows), block):
        (s if start < len(rows) / 2 else other).absorb(rows[start : start + block])
    if other.n:
        s.join(other)
    wanted = scatter(rows)
    size = max(np.abs(wanted).max(), 1e-300)
    assert s.n == len(rows) and np.abs(s.mean - rows.mean(axis=0)).max() < 1e-12 * max(1, np.abs(rows).max())
    assert np.abs(s.basis.T @ s.basis - np.eye(s.basis.shape[1])).max(initial=0) < 1e-13
    assert np.abs(s.basis * s.values @ s.basis.T - wanted).max() < 1e-12 * size


def test_secular_roots_between_their_poles():
    for _ in range(200):
        k = int(RNG.integers(1, 12))
        d = np.cumsum(10.0 ** RNG.uniform(-9, 2, k))
        z = 10.0 ** RNG.uniform(-6, 1, k) * RNG.choice([-1, 1], k)
        origin, y = W.secular_roots(d, z)
        got, wanted = d[origin] + y, np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
        assert np.abs(got - wanted).max() < 1e-13 * wanted[-1]
        assert (got >= d).all() and (got[:-1] <= d[1:]).all()


def definition(vectors):
    """Steps, deviations and the dense eigendecomposition, written out with Python's whole numbers."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, total = len(x), x.sum(axis=0)
    deviation = [sum(int(n * a - s) ** 2 for a, s in zip(row, total)) for row in x]
    gap = np.array([[int(n * a - s) / n for a, s in zip(row, total)] for row in x])
    values, basis = np.linalg.eigh(gap.T @ gap / n)
    return n, deviation, gap, values[::-1], basis[:, ::-1]


@pytest.mark.parametrize("parts", [1, 5])
def test_query_on_the_whole_table(spark, parts, monkeypatch):
    if parts > 1:
        monkeypatch.setattr(W, "FAN_IN", 2)
        monkeypatch.setattr(queries, "table", lambda spark, sf, name: spark.read.parquet(f"{sf}/{name}.parquet").repartition(parts))
    rows = queries.op11(spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    n, deviation, gap, values, basis = definition(table["embedding"])
    wide = rows.pivot(index="vec_id", columns="component", values="whitened").loc[table["vec_id"]].to_numpy()
    assert wide.shape == (n, 32) and set(rows["n"]) == {n}
    assert rows[rows["component"] == 1].set_index("vec_id")["deviation"].loc[table["vec_id"]].tolist() == deviation
    share = rows.drop_duplicates("component").sort_values("component")["explained"].to_numpy()
    assert np.allclose(share, values[:32] / values.sum(), rtol=1e-9)
    plain = gap @ basis[:, :32] / np.sqrt(values[:32])
    for j in range(32):
        assert min(np.abs(wide[:, j] - plain[:, j]).max(), np.abs(wide[:, j] + plain[:, j]).max()) < 1e-7
    error = np.abs(np.cov(wide.T, bias=True) - np.eye(32)).max()
    assert set(rows["identity_error"] < 1e-9) == {True} and error < 1e-9


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5], "x"), (1, [1.0, 2.0, 0.5], "x"), (2, [0.0, -1.0, 3.5], "x"), (None, [4.0, 0.0, 0.25], "x"), (3, None, "x"), (4, [1.0, None, 2.0], "x"), (5, [1.0, nan, 2.0], "x"), (6, [inf, 0.0, 0.0], "x"), (7, [], "x"), (8, [-2.0, 1.0, 1.0], "x")]
    names = "key emb part dim n total mean vals basis deviation whitened at".split()
    schema = "vec_id BIGINT, embedding ARRAY<FLOAT>, " + ", ".join(f"`{c}` STRING" for c in names)
    df = spark.createDataFrame([(i, v, *[t] * len(names)) for i, v, t in rows], schema).repartition(3)
    model = W.fit(df, grid=W.Grid())
    out = W.transform(df, model).collect()
    assert model.n == 5 and sorted(str(r.vec_id) for r in out) == ["1", "1", "2", "8", "None"]
    _, deviation, _, values, _ = definition([v for i, v, _ in rows if i in (1, 2, None, 8)])
    assert sorted(r.deviation for r in out) == sorted(deviation)
    assert np.allclose(model.values, values) and W.identity_error(df, model) < 1e-9
    free = W.fit(df, components=2)
    assert len(free.values) == 2 and {r.deviation for r in W.transform(df, free).collect()} == {None}


def test_nothing_and_no_variance(spark):
    none = spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    assert W.fit(none) is None
    flat = spark.createDataFrame([(i, [2.0, 3.0]) for i in range(4)], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    model = W.fit(flat, grid=W.Grid())
    assert len(model.values) == 0 and W.identity_error(flat, model) == 0.0
    assert {tuple(r.whitened) for r in W.transform(flat, model).collect()} == {()}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    assert len(W.fit(line).values) == 1


def test_vectors_of_another_length(spark):
    odd = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id BIGINT, embedding ARRAY<FLOAT>").repartition(2)
    with pytest.raises(Exception, match="components"):
        W.fit(odd)
