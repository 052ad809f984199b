"""Dual members through the ensemble, and fold machines from shared sums against refitting."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexmesh.operators import augment as AU
from lexmesh.operators import ensemble as EN
from lexmesh.operators import svm
from lexmesh.operators import tuning as TU

COLUMNS = [c.split()[0] for c in EN.MODEL_SCHEMA.split(", ")]


def training(spark, n=30, dim=6, seed=5):
    rng, rows = np.random.RandomState(seed), []
    for cat, sign in (("A", 1), ("B", -1)):
        for i in range(n):
            v = rng.normal(0, 1.0, dim)
            v[0] += 2.0 * sign
            rows.append((cat, i, f"{cat}{i}", True, None, v.tolist()))
            w = rng.normal(0, 1.0, dim)
            w[0] -= 2.0 * sign
            rows.append((cat, n + i, f"o{cat}{i}", False, ["S", "T"][i % 2], w.tolist()))
    return spark.createDataFrame(rows, "category string, row_id long, term string, inside boolean, "
                                       "src_category string, vec array<double>")


@pytest.mark.parametrize("kernel,pca", [("rbf", None), ("linear", None), ("rbf", 0.5)])
def test_dual_members_separate_and_score_as_solved(spark, kernel, pca):
    tr = training(spark)
    members = AU.member_rows(AU.ensemble_training_set(tr, 2, 2, 2, seed=1), 2)
    params = {0: {"kernel": kernel, "pca": pca, "solver": "dual"}}
    models = EN.fit_ensemble(members, params, seed=1)
    rows = [r.asDict() for r in models.collect()]
    assert len(rows) == 4 and all(m["gap"] <= svm.TOL and len(m["support"]) == len(m["coef"]) * (m["n_comp"] or 6) for m in rows)
    assert all(abs(sum(m["coef"])) < 1e-6 * len(m["coef"]) for m in rows)  # sum(alpha t) = 0
    test = tr.withColumn("id", F.col("row_id"))
    proba = EN.predict_proba(test, models, id_cols=("id", "inside", "term")).where("term LIKE concat('%', category, '%')").collect()
    assert all(0 <= r["proba"] <= 1 for r in proba)
    least = .75 if pca else .9  # half of the rotated axes hold part of what tells the classes apart
    assert np.mean([(r["proba"] > 0.5) == r["inside"] for r in proba]) > least
    # decision values of a collected row equal the dual's own
    pdf = members.where("category = 'A' AND model_ix = 1").toPandas()
    x, y = np.vstack(pdf["vec"]), pdf["inside"].to_numpy()
    m = EN.fit_member(x, y, kernel=kernel, pca=pca, solver="dual")
    z = EN.projected(x, m)
    k = svm.Kernel(z, kernel, m["gamma"])
    d = svm.solve(k, y, svm.bounds(y, 1.0))
    assert np.allclose(EN.decision(x, m), k.between(z) @ (d.alpha * np.where(y, 1, -1)) + d.intercept)


def test_unknown_solver():
    with pytest.raises(ValueError):
        EN.fit_member(np.zeros((4, 2)), np.array([True, False, True, False]), solver="other")


def frame(seed=0, n=240, dim=4):
    rng = np.random.default_rng(seed)
    inside = rng.random(n) < .3
    vec = rng.normal(size=(n, dim)) + inside[:, None]
    return pd.DataFrame({"category": "A", "model_ix": 1, "fold": rng.integers(0, 4, n), "inside": inside, "kind": "sample",
                         "sample_id": np.arange(n), "vec": list(vec)})


def refit(x, y, m, svc_c):
    """The weighted least-squares machine by its definition, on rows as they are."""
    z = EN.projected(x, m)
    phi = EN._rff(z, m["rff_seed"], m["gamma"], m["n_rff"]) if m["kernel"] == "rbf" else z
    a = np.hstack([phi, np.ones((len(x), 1))])
    w = np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (~y).sum()))
    reg = np.eye(a.shape[1]) / svc_c
    reg[-1, -1] = 1e-8
    sol = np.linalg.solve((a * w[:, None]).T @ a + reg, (a * w[:, None]).T @ np.where(y, 1.0, -1.0))
    return sol, a @ sol


def test_fold_machines_equal_refitting(monkeypatch):
    params = {0: {"svc_c": .1, "n_rff": 32}, 1: {"svc_c": 10.0, "n_rff": 32}, 2: {"kernel": "linear", "svc_c": 1.0},
              3: {"pca": 3, "n_rff": 16, "svc_c": 1.0}, 4: {"n_models": 1}}
    pdf = frame()
    got = EN._fold_models_fn(params, 7, 10)(pdf)
    assert list(got.columns) == COLUMNS and len(got) == 4 * 4  # the set with one model has no member 1
    monkeypatch.setattr(EN, "FEATURE_ROWS", 7)
    again = EN._fold_models_fn(params, 7, 10)(pdf.sample(frac=1, random_state=1))
    for m, n in zip(got.to_dict("records"), again.to_dict("records")):
        assert np.allclose(m["coef"], n["coef"])
        rest = (pdf["fold"] != m["fold"]).to_numpy()
        x, y = np.vstack(pdf["vec"])[rest], pdf["inside"].to_numpy()[rest]
        sol, values = refit(x, y, m, params[m["param_id"]]["svc_c"])
        assert np.allclose(m["coef"], sol[:-1]) and np.isclose(m["intercept"], sol[-1])
        assert np.allclose((m["platt_a"], m["platt_b"]), EN._platt(values, y))
        assert m["n_rows"] == rest.sum() and m["n_inside"] == y.sum()
        assert np.allclose(EN.decision(x, m), values)


def test_fold_machines_by_the_dual():
    pdf = frame(3, 90)
    got = EN._fold_models_fn({5: {"solver": "dual", "svc_c": 2.0}}, 0, 10)(pdf)
    for m in got.to_dict("records"):
        rest = (pdf["fold"] != m["fold"]).to_numpy()
        x, y = EN.projected(np.vstack(pdf["vec"])[rest], m), pdf["inside"].to_numpy()[rest]
        k = svm.Kernel(x, "rbf", m["gamma"])
        d = svm.solve(k, y, svm.bounds(y, 2.0))
        want = k.between(x) @ (d.alpha * np.where(y, 1, -1)) + d.intercept
        # rows come in another order there, so the two end at other points within the gap
        assert m["gap"] <= svm.TOL and np.allclose(EN.decision(np.vstack(pdf["vec"])[rest], m), want, atol=20 * svm.TOL)


def test_each_augmented_row_is_made_once(spark):
    """One row for each sample, not one for each fold and parameter set."""
    tr = TU.assign_folds(training(spark), 5, seed=2)
    ens = AU.ensemble_training_set(tr, 2, 3, 2, seed=0, group_cols=("fold",))
    rows = AU.member_rows(ens, 2)
    n_in = 30
    assert rows.count() == 2 * 2 * (n_in * 3 + n_in + n_in * 3 * 2 + n_in)
    grid = [{"svc_c": [.1, 1.0, 10.0], "n_rff": [16], "n_models": [2]}]
    scores, ranked, best, params = TU.tune_params(training(spark), grid, cv=5, n_best=2, n_models=2, multiplier=2,
                                                  multiplier_outside=2)
    found = scores.collect()
    assert len(found) == 2 * 3 * 5 and all(0 <= r.score <= 1 for r in found)
    assert np.mean([r.score for r in found]) > .8
    assert best.count() == 4 and sorted(params) == [0, 1, 2]
    one = TU.cross_val_score(training(spark), {"n_rff": 16}, cv=3, n_models=1, multiplier=2, multiplier_outside=1)
    assert one.columns == ["category", "fold", "score"] and one.count() == 6
