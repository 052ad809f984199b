"""Augmented rows as draws: the same vectors, the same machines, no joins of vectors."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmesh.operators import augment as AU
from lexmesh.operators import ensemble as EN
from lexmesh.operators import tuning as TU
from lexmesh.operators.draws import Drawn, span_draws


def training(spark, n=12, dim=5):
    rng = np.random.RandomState(3)
    rows = []
    for c in ("A", "B"):
        rows += [(c, k, True, None, (rng.normal(size=dim) + 1).tolist()) for k in range(n)]
        rows += [(c, n + k, False, ("B" if c == "A" else "A", "S", None)[k % 3], (rng.normal(size=dim) - 1).tolist())
                 for k in range(2 * n)]
    return spark.createDataFrame(rows, "category string, row_id long, inside boolean, src_category string, vec array<double>")


def test_vectors_of_draws_are_the_rows_they_name(spark):
    tr = training(spark)
    by_id = {(r.category, r.row_id): np.array(r.vec) for r in tr.collect()}
    rows = {(r.category, r.model_ix, r.inside, r.kind, r.sample_id): r for r in AU.ensemble_training_set(tr, 2, 2, 2, seed=4).collect()}
    draws = AU.ensemble_training_set(tr, 2, 2, 2, seed=4, vectors=False).collect()
    assert len(rows) == len(draws) == 2 * (12 * 3 + 2 * (12 * 4 + 12))
    own = {c: [k for k in range(12)] for c in "AB"}
    out = {(c, s): [12 + k for k in range(24) if k % 3 == s] for c in "AB" for s in range(3)}
    for d in draws:
        # a null source comes first, then the names in order
        pool = own[d.category] if d.pool == -1 else list(range(12, 36)) if d.pool == -2 else out[d.category, (2, 0, 1)[d.pool]]
        at, w = [pool[x // 11] for x in d.draws], np.array([x % 11 for x in d.draws], float)
        want = sum(a * by_id[d.category, k] for a, k in zip(w / w.sum(), at))
        sample = at[0] if d.inside and d.kind == "original" else d.sample_id
        assert np.allclose(rows[d.category, d.model_ix, d.inside, d.kind, sample].vec, want)


def test_no_row_of_vectors_is_joined_or_broadcast(spark):
    """Samples were broadcast whole (a generated row's size is not estimated), and their
    vectors moved once for each draw."""
    for vectors in (True, False):
        s = AU.ensemble_training_set(training(spark), 2, vectors=vectors)
        plan = s._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") <= (1 if vectors else 0)  # the training rows with two numbers of their category


@pytest.mark.parametrize("given", [{}, {"kernel": "linear", "pca": 0.5}, {"solver": "dual", "n_rff": 16}])
def test_machines_from_draws(spark, given):
    tr, params = training(spark), {0: given}
    whole = EN.fit_ensemble(AU.member_rows(AU.ensemble_training_set(tr, 2, 2, 2), 2), params, seed=1)
    drawn = EN.fit_ensemble(AU.member_rows(AU.ensemble_training_set(tr, 2, 2, 2, vectors=False), 2), params, 1, tr, 2)
    probas = [{(r.id, r.category): r.proba for r in EN.predict_proba(
        tr.select(F.struct("category", "row_id").cast("string").alias("id"), "vec"), m).collect()} for m in (whole, drawn)]
    assert probas[0] == pytest.approx(probas[1], abs=1e-2 if given.get("solver") else 1e-6)
    assert sorted(r.n_rows for r in drawn.collect()) == [12 * 3 + 12 * 5] * 4


def test_fold_machines_from_draws(spark):
    tr = TU.assign_folds(training(spark), 3).cache()
    params = {0: {"n_rff": 16}, 1: {"kernel": "linear", "svc_c": .1}}
    found = []
    for vectors in (True, False):
        rows = AU.member_rows(AU.ensemble_training_set(tr, 2, 2, 2, group_cols=("fold",), vectors=vectors), 2)
        models = EN.fit_folds(rows, params, 0, 2, *(() if vectors else (tr, 2))).orderBy("category", "param_id", "fold", "model_ix").collect()
        found.append(np.array([[*m.coef[:5], m.intercept, m.gamma, m.platt_a, m.platt_b, m.n_rows] for m in models]))
    assert found[0].shape == (2 * 2 * 2 * 3, 10) and np.allclose(*found, atol=1e-6)


def test_a_fit_holds_a_block_of_rows_only(monkeypatch):
    """The vectors of a member's rows are never made together."""
    rng = np.random.RandomState(0)
    n, dim = 300, 4
    tr = pa.table({"row_id": np.arange(40), "inside": np.arange(40) < 20, "src_category": ["S"] * 40,
                   "vec": pa.array([(rng.normal(size=dim) + (2 if k < 20 else 0)).tolist() for k in range(40)])})
    inside = np.arange(n) < 100
    rows = pa.table({"kind": ["sample"] * n, "pool": pa.array(np.where(inside, -1, 0), pa.int32()),
                     "draws": pa.array([[int(p) * 11 + int(w) for p, w in zip(rng.randint(0, 20, 3), rng.randint(1, 11, 3))]
                                        for _ in range(n)])})
    drawn, seen = Drawn(rows, tr), []
    whole = drawn.of(slice(0, n))
    one = EN.fit_member(whole, inside, pca=0.5, n_rff=8, seed=5)
    of = Drawn.of
    monkeypatch.setattr(Drawn, "of", lambda self, here: seen.append(here.stop - here.start) or of(self, here))
    monkeypatch.setattr(EN, "FEATURE_ROWS", 7)
    got = EN.fit_member(drawn, inside, pca=0.5, n_rff=8, seed=5)
    assert max(seen) == 7
    for k in ("mean", "scale", "components", "gamma", "coef", "intercept", "platt_a"):
        assert np.allclose(got[k], one[k], atol=1e-6)


@pytest.mark.parametrize("n_draw", [3, 9])
def test_spans_name_the_draws(spark, monkeypatch, n_draw):
    """A row for each draw was moved to every member; now a row for each span of them is."""
    monkeypatch.setattr(AU, "SPAN", 7)
    tr = TU.assign_folds(training(spark), 3)
    args = dict(n_models=2, multiplier=2, multiplier_outside=2, n_draw=n_draw, seed=4, group_cols=("fold",))
    spans = AU.ensemble_training_set(tr, spans=True, **args).collect()
    got = {}
    for s in spans:
        pool, place, weights = span_draws(s.asDict())
        for k in range(s.n):
            got[s.fold, s.category, s.model_ix, s.inside, s.kind, s.sample_id + k] = (pool[k], [*(place[k] * 11 + weights[k])])
    want = {(r.fold, r.category, r.model_ix, r.inside, r.kind, r.sample_id): (r.pool, r.draws)
            for r in AU.ensemble_training_set(tr, vectors=False, **args).collect()}
    assert got == want and len(spans) < len(want) / 3


def test_machines_from_spans_are_those_from_draws(spark):
    tr = TU.assign_folds(training(spark), 3).cache()
    params = {0: {"n_rff": 16}}
    found = []
    for form in ({"vectors": False}, {"spans": True}):
        rows = AU.member_rows(AU.ensemble_training_set(tr.drop("fold"), 2, 2, 2, **form), 2)
        folded = AU.member_rows(AU.ensemble_training_set(tr, 2, 2, 2, group_cols=("fold",), **form), 2)
        models = EN.fit_ensemble(rows, params, 1, tr.drop("fold"), 2).unionByName(EN.fit_folds(folded, params, 0, 2, tr, 2))
        found.append(sorted(map(tuple, models.drop("components", "support").collect())))
    assert found[0] == found[1] and len(found[0]) == 2 * 2 + 2 * 2 * 3
