"""Merged moments and principal components against numpy on whole groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmesh.operators import covariance as C


@pytest.mark.parametrize("dim", [64, 300])
def test_components_equal_numpy(spark, dim):
    rng = np.random.default_rng(dim)
    data = {("a", 1): rng.normal(size=(500, dim)) * np.linspace(5, 1, dim) + 1000.0, ("b", None): rng.normal(size=(40, dim)),
            ("c", 2): rng.normal(size=(1, dim))}
    rows = [(k, i, v.tolist()) for (k, i), x in data.items() for v in x] + [("a", 1, None)]
    df = spark.createDataFrame(rows, "k string, i int, vec array<double>").repartition(7)
    got = {(r.k, r.i): r for r in C.moments(df, ["k", "i"]).collect()}
    assert set(got) == set(data)
    for key, x in data.items():
        assert got[key].n == len(x) and np.allclose(got[key].mean, x.mean(axis=0))
        assert np.allclose(np.reshape(got[key].centred, (dim, dim)) / len(x), np.cov(x.T, bias=True), atol=1e-9)
    comps = C.principal_components(df.where("k = 'a'"), ["k"], 5).orderBy("component").collect()
    _, s, vt = np.linalg.svd(data["a", 1] - data["a", 1].mean(axis=0), full_matrices=False)
    assert [r.component for r in comps] == list(range(5)) and np.allclose([r.variance for r in comps], s[:5] ** 2 / 500)
    for r, v in zip(comps, vt):
        v = v * np.sign(v[np.abs(v).argmax()])
        assert np.allclose(r.vec, v, atol=1e-6)


def test_merging_in_any_order_is_exact():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1000, 4)) * 1e-3 + 1e6  # products without centring would lose all digits
    cuts = np.sort(rng.choice(999, 20, replace=False) + 1)
    parts = [C.Moments.of(p) for p in np.split(x, cuts)]
    rng.shuffle(parts)
    while len(parts) > 1:
        parts.append(parts.pop(0).merged(parts.pop(0)))
    assert parts[0].n == 1000 and np.allclose(parts[0].covariance(), np.cov(x.T, bias=True), rtol=1e-6)


def test_covariance_cells_without_keys_and_empty(spark):
    x = np.arange(12.0).reshape(4, 3) ** 2
    df = spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>")
    want = np.cov(x.T, bias=True)
    got = {(r.i, r.j): r.covariance for r in C.covariances(df, []).collect()}
    assert set(got) == {(i, j) for i in range(3) for j in range(i, 3)} and all(np.isclose(v, want[k]) for k, v in got.items())
    assert C.covariances(df.where(F.lit(False)), []).count() == 0
