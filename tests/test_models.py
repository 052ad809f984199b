"""Training rows, augmentation, ensembles, tuning helpers, scaling signs,
batch resume and streaming (invariants and goldens)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmesh.operators import augment as AU
from lexmesh.operators import ensemble as EN
from lexmesh.operators import tuning as TU
from lexmesh.operators.scaling import LatentSemanticScaling
from lexmesh.sources import lexicon_io as IO

WORDS = ["Ufer", "Boot", "Segel", "Amboss", "Zange", "Kreide", "Tafel", "Pinsel", "Nebel", "Hagel"]


def _vectors(spark, words, dim=8, seed=1):
    rng = np.random.RandomState(seed)
    return spark.createDataFrame([(w, rng.normal(size=dim).tolist()) for w in words],
                                 "word string, vec array<double>")


def test_training_rows_small_lexica(spark):
    main = IO.lexicon_from_dict(spark, {"A1": ["Ufer", "Boot", "Segel"],
                                        "A2": ["Amboss", "Zange"]})
    sup = IO.lexicon_from_dict(spark, {"B1": ["Kreide", "Tafel", "Pinsel"], "B2": ["Nebel", "Hagel"]})
    emb = AU.embedded_lexicon(main, _vectors(spark, WORDS), sup)
    tr = AU.training_rows(emb, ["A1", "A2"], ["B1", "B2"])
    flags = {c: sorted((r["inside"] for r in tr.where(F.col("category") == c).collect()),
                       reverse=True) for c in ("A1", "A2")}
    assert flags["A1"] == [True] * 3 + [False] * 7
    assert flags["A2"] == [True] * 2 + [False] * 8


def test_outside_excludes_shared_terms(spark):
    main = IO.lexicon_from_dict(spark, {"A1": ["Amboss", "Ufer"], "A2": ["Amboss", "Zange"]})
    emb = AU.embedded_lexicon(main, _vectors(spark, WORDS))
    tr = AU.training_rows(emb, ["A1", "A2"])
    out = {r["term"] for r in tr.where((F.col("category") == "A1") & ~F.col("inside")).collect()}
    assert out == {"Zange"}


def _separable_training(spark, n=40, dim=16):
    rng = np.random.RandomState(0)
    mu = np.zeros(dim)
    mu[0] = 3.0
    rows = []
    for i in range(n):
        rows.append(("A", i, f"a{i}", True, None, (mu + rng.normal(size=dim)).tolist()))
        rows.append(("A", n + i, f"b{i}", False, "B" if i % 2 else "C",
                     (-mu + rng.normal(size=dim)).tolist()))
    return spark.createDataFrame(rows, "category string, row_id long, term string, inside boolean, "
                                       "src_category string, vec array<double>")


def test_augmentation_counts_and_convexity(spark):
    tr = _separable_training(spark)
    ens = AU.ensemble_training_set(tr, n_models=2, multiplier=5, multiplier_outside=5, seed=3)
    counts = {(r["model_ix"], r["inside"], r["kind"]): r["n"] for r in
              ens.groupBy("model_ix", "inside", "kind").count().withColumnRenamed("count", "n")
              .collect()}
    assert counts[(-1, True, "sample")] == 200 and counts[(-1, True, "original")] == 40
    assert counts[(0, False, "sample")] == 1000 and counts[(1, False, "original")] == 40
    # reproducible: the same seed gives the same rows
    a = ens.select(F.sum(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x))).first()[0]
    b = AU.ensemble_training_set(tr, 2, 5, 5, seed=3).select(
        F.sum(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x))).first()[0]
    assert abs(a - b) < 1e-9


@pytest.mark.parametrize("kernel,pca", [("rbf", None), ("linear", None), ("rbf", 0.5)])
def test_ensemble_separates_fixture(spark, kernel, pca):
    tr = _separable_training(spark)
    members = AU.member_rows(AU.ensemble_training_set(tr, 2, 5, 5, seed=1), 2)
    models = EN.fit_ensemble(members, {0: {"kernel": kernel, "pca": pca, "n_rff": 128}}, seed=1)
    test = _separable_training(spark).withColumn("id", F.col("row_id"))
    proba = EN.predict_proba(test, models, id_cols=("id", "inside")).collect()
    assert all(0.0 <= r["proba"] <= 1.0 for r in proba)
    acc = np.mean([(r["proba"] > 0.5) == r["inside"] for r in proba])
    assert acc > 0.9


def test_fold_mean_and_ranks(spark):
    cv = spark.createDataFrame([(0, 0, float("nan")), (1, 0, None), (0, 1, 0.25),
                                (1, 1, 0.9), (0, 2, 0.35), (1, 2, 0.7)],
                               "param_id int, fold int, score double")
    means = {r["param_id"]: r["mean_score"] for r in TU.cv_mean_nonmissing(cv).collect()}
    assert means == pytest.approx({0: 0.3, 1: 0.8})
    m = spark.createDataFrame([(0, 0.15), (1, 0.75), (2, 0.45)], "param_id int, mean_score double")
    ranks = {r["param_id"]: r["rank"] for r in TU.score_ranks(m).collect()}
    assert ranks == {0: 2, 1: 0, 2: 1}
    best = [r["param_id"] for r in TU.best_params(TU.score_ranks(m), 2).orderBy("rank").collect()]
    assert best == [1, 2]


def test_f1_zero_denominator_is_zero(spark):
    df = spark.createDataFrame([(0, False), (0, False)], "label int, prediction boolean")
    assert TU.f1_score(df).first()["score"] == 0.0


def test_draw_weights_are_never_all_zero(spark):
    """Any number of draws; every weight is 0..10 and no vector is zero."""
    for n in (1, 2, 3, 9):
        df = spark.range(4000).select(F.col("id").cast("string").alias("sample_key"))
        got = df.select(F.lit(0).alias("x"), AU.draw_weights(n, 5).alias("w")).collect()
        assert all(len(r["w"]) == n and max(r["w"]) > 0 and min(r["w"]) >= 0 and max(r["w"]) <= 10 for r in got)
        assert len({tuple(r["w"]) for r in got}) > min(9, 11 ** n - 2)


def test_more_than_four_draws(spark):
    tr = _separable_training(spark)
    ens = AU.ensemble_training_set(tr, n_models=1, multiplier=2, multiplier_outside=1, n_draw=6)
    assert ens.where((F.col("kind") == "sample") & F.col("inside")).count() == 80


def test_scaling_signs_and_unfitted(spark):
    dim = 6
    e = np.eye(dim)
    vecs = {"hell": e[0] * 2, "warm": e[0] + 0.1 * e[1], "sanft": e[0] + 0.3 * e[2],
            "kalt": -e[0] + 0.1 * e[3], "rau": -e[0] * 3, "grau": -e[0] + 0.2 * e[4],
            "Stein": e[5]}
    wv = spark.createDataFrame([(k, v.tolist()) for k, v in vecs.items()],
                               "word string, vec array<double>")
    pol = IO.polarity_from_pairs({"hell": 0.8, "warm": 0.6, "kalt": -0.6, "rau": -0.8}, spark)
    docs = spark.createDataFrame([(1, "hell warm Stein"), (2, "grau kalt"), (3, "ohne Treffer")],
                                 "doc_id long, text string")
    est = LatentSemanticScaling(wv, method="allwords")
    assert not hasattr(est, "predict_docs")          # unfitted estimator cannot predict (P11)
    model = est.fit(pol, docs)
    words = spark.createDataFrame([(w,) for w in ["warm", "sanft", "kalt", "grau"]],
                                  "word string")
    got = {r["word"]: r["polarity"] for r in model.predict_words(words).collect()}
    assert got["warm"] > 0 and got["sanft"] > 0
    assert got["kalt"] < 0 and got["grau"] < 0
    d = {r["doc_id"]: r["polarity"] for r in model.predict_docs(docs).collect()}
    assert d[1] > d[2] and d[3] is None                # no in-vocabulary token -> null (Q23)


def test_connected_components_on_chains(spark):
    """Label propagation with pointer jumping finds chain components."""
    from lexmesh.operators.clusters import cluster_words
    n = 40
    words = spark.createDataFrame([(f"w{i:03d}", i) for i in range(n)], "word string, idx long")
    edges = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(19)] + \
            [(f"w{i + 1:03d}", f"w{i:03d}") for i in range(25, 39)]
    pairs = spark.createDataFrame([(a, b, 0.9) for a, b in edges],
                                  "word_a string, word_b string, cosine double")
    got = {r["word"]: r["cluster_id"] for r in cluster_words(words, pairs).collect()}
    want = {f"w{i:03d}": (0 if i < 20 else (i if i < 25 else 25)) for i in range(n)}
    assert got == want


def test_word_scores_go_to_the_documents(spark, monkeypatch):
    """By the size of the vectors' files, not of the scores, every count was moved to its word and back."""
    from lexmesh.operators import scaling as S
    words = spark.createDataFrame([(f"w{k}", [float(k), 1.0]) for k in range(50)], "word string, vec array<double>")
    docs = spark.createDataFrame([(k, " ".join(f"w{k * j % 60}" for j in range(k))) for k in range(30)] + [(99, None)],
                                 "doc_id long, text string").repartition("doc_id")
    axis = S.PolarityAxis([0.6, 0.8], 3)
    default = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = S.doc_polarity_allwords(docs, words, axis)
        assert "hashpartitioning(word" not in sent._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(S, "SCORE_BYTES", 0)
        by_word = S.doc_polarity_allwords(docs, words, axis)
        assert "hashpartitioning(word" in by_word._jdf.queryExecution().executedPlan().toString()
        got, want = ({r.doc_id: r.polarity for r in df.collect()} for df in (sent, by_word))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", default)
    assert got.keys() == want.keys() and got[99] is None and got[0] is None
    assert all(got[k] == pytest.approx(want[k]) for k in range(1, 30))
