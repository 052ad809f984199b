"""Members of categories that are too large for one task: the whole category, in parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmesh.operators import augment as AU
from lexmesh.operators import ensemble as EN
from lexmesh.operators import parts as PA
from lexmesh.operators import tuning as TU
from test_draws import training

NUMBERS = ("mean", "scale", "components", "coef", "intercept", "gamma", "platt_a", "platt_b", "n_rows", "n_inside")


@pytest.fixture
def small_parts(monkeypatch):
    """Small parts; when called, ten labelled rows of a class are too many for a task."""
    monkeypatch.setattr(PA, "PART_ROWS", 16)
    monkeypatch.setattr(PA, "READ_ROWS", 7)
    monkeypatch.setattr(AU, "SPAN", 8)
    return lambda most=10: monkeypatch.setattr(PA, "GROUP_ROWS", most)


def test_every_labelled_row_is_learned_from(spark):
    """At most 20,000 rows of a class were taken, by hash."""
    rows = spark.range(90_000).select(
        F.when(F.col("id") < 25_000, "A").otherwise("B").alias("category"), F.col("id").alias("pos"),
        F.col("id").cast("string").alias("term"), F.array(F.col("id").cast("double")).alias("vec"), F.col("id").alias("row_id"))
    found = {(r.category, r.inside): r["count"] for r in AU.training_rows(rows, ["A", "B"]).groupBy("category", "inside").count().collect()}
    assert found == {("A", True): 25_000, ("A", False): 65_000, ("B", True): 65_000, ("B", False): 25_000}


def machines(df):
    rows = df.orderBy("category", "param_id", "fold", "model_ix").collect()
    return [(r.category, r.param_id, r.fold, r.model_ix, r.kernel, r.n_comp, r.rff_seed, r.solver) for r in rows], \
        [np.concatenate([np.ravel(r[c]) for c in NUMBERS]) for r in rows]


def alike(one, other):
    assert one[0] == other[0] and one[0]
    for a, b in zip(one[1], other[1]):
        assert np.allclose(a, b, rtol=1e-6, atol=1e-6)


def test_vectors_by_parts(spark, small_parts):
    tr = TU.assign_folds(training(spark), 2).cache()
    found = {}
    for large in (False, True):
        if large:
            small_parts()
        for group in (("fold",), ()):
            df = AU.ensemble_training_set(tr, 2, 2, 2, n_draw=5, seed=4, group_cols=group)
            by = [c for c in df.columns if c != "vec"]
            found[group, large] = {tuple(r[c] for c in by): r.vec for r in df.collect()}, df.columns
    for group in (("fold",), ()):
        (one, names), (other, others) = found[group, False], found[group, True]
        assert names == others and one.keys() == other.keys()
        assert all(np.allclose(v, other[k]) for k, v in one.items())


def test_members_by_parts(spark, small_parts):
    tr = training(spark).cache()
    params = {0: {"n_rff": 16}, 1: {"kernel": "linear", "pca": 0.5}, 2: {"solver": "dual"}}
    both = tr.withColumn("param_id", F.explode(F.array(*[F.lit(k) for k in params])))
    rows = AU.member_rows(AU.ensemble_training_set(both, 2, 2, 2, group_cols=("param_id",), spans=True), 2)
    whole = machines(EN.fit_ensemble(rows, params, 1, both, 2).where("param_id < 2"))
    small_parts()
    rows = AU.member_rows(AU.ensemble_training_set(both, 2, 2, 2, group_cols=("param_id",), spans=True), 2)
    fitted = EN.fit_ensemble(rows, params, 1, both, 2)
    alike(whole, machines(fitted.where("param_id < 2")))
    assert fitted.where("solver = 'dual'").count() == 4


def test_fold_members_by_parts(spark, small_parts):
    tr = TU.assign_folds(training(spark), 3).cache()
    params = {0: {"n_rff": 16}, 1: {"n_rff": 16, "svc_c": .1}, 2: {"kernel": "linear", "pca": 3}, 3: {"kernel": "linear", "n_models": 1}}
    rows = AU.member_rows(AU.ensemble_training_set(tr, 2, 2, 2, group_cols=("fold",), spans=True), 2)
    whole = machines(EN.fit_folds(rows, params, 0, 2, tr, 2))
    small_parts()
    alike(whole, machines(EN.fit_folds(rows, params, 0, 2, tr, 2)))


def test_held_out_rows_are_scored_in_parts(spark, small_parts):
    tr = training(spark)
    found = [{(r.category, r.fold): r.score for r in TU.cross_val_score(tr, {"n_rff": 16}, 3, 2, 2, 2).collect()}]
    small_parts(3)
    found.append({(r.category, r.fold): r.score for r in TU.cross_val_score(tr, {"n_rff": 16}, 3, 2, 2, 2).collect()})
    assert found[0] == pytest.approx(found[1]) and len(found[0]) == 6
