"""The classifier estimator and the document processor, end to end on sf0.001."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmesh.operators.classifier import ClassifierModel, LexiconClassifier, load_classifier
from lexmesh.operators.processor import fit_processor
from lexmesh.operators.scaling import LatentSemanticScaling, load_scaling
from lexmesh.operators.tokens import stopword_list
from lexmesh.plans import fixtures as fx
from lexmesh.sources import lexicon_io as IO

GRID = [{"kernel": ["rbf", "linear"], "svc_c": [0.5], "n_rff": [32]}]


def _toy(spark, n=30, dim=8):
    """Two separable categories and a support one: words and vectors."""
    rng = np.random.RandomState(4)
    words, lex = [], {"A": [], "B": [], "S": []}
    for k, cat in enumerate(lex):
        mu = np.zeros(dim)
        mu[k] = 4.0
        for i in range(n):
            words.append((f"{cat.lower()}{i}", (mu + rng.normal(size=dim)).tolist()))
            lex[cat].append(f"{cat.lower()}{i}")
    wv = spark.createDataFrame(words, "word string, vec array<double>")
    main = IO.lexicon_from_dict(spark, {k: lex[k] for k in "AB"})
    return wv, main, IO.lexicon_from_dict(spark, {"S": lex["S"]})


def test_unfitted_has_no_predictions(spark):
    wv, *_ = _toy(spark)
    assert not any(x.startswith("predict") for x in dir(LexiconClassifier(wv)))
    assert any(x.startswith("predict") for x in dir(ClassifierModel))


def test_tuned_fit_separates_and_averages_sets(spark):
    wv, main, support = _toy(spark)
    model = LexiconClassifier(wv, n_models=2, multiplier=2, multiplier_outside=1, test_size=0.25).fit(
        main, support, ["A", "B"], ["S"], hp_tuning=True, param_grid=GRID, n_best_params=2, cv=3)
    sets = model.members.groupBy("category").agg(F.countDistinct("param_id").alias("n")).collect()
    assert {r["category"] for r in sets} == {"A", "B"} and all(1 <= r["n"] <= 2 for r in sets)
    flags = {r["word"]: (r["A"], r["B"]) for r in model.predict_words(wv.select("word")).collect()}
    right = [flags[w] == ((w[0] == "a") * 1, (w[0] == "b") * 1) for w in flags]
    assert len(right) == 90 and np.mean(right) > 0.9
    assert all(r["score"] > 0.7 for r in model.test_scores().collect())


def test_blocks_of_models_give_the_same_scores(spark):
    from lexmesh.operators.ensemble import predict_proba
    wv, main, support = _toy(spark)
    model = LexiconClassifier(wv, n_models=3, multiplier=1, multiplier_outside=1).fit(
        main, support, ["A", "B"], ["S"], fixed_params={"n_rff": 16})
    one = {tuple(r)[:2]: r["proba"] for r in predict_proba(wv, model.members, ("word",)).collect()}
    many = {tuple(r)[:2]: r["proba"] for r in predict_proba(wv, model.members, ("word",), max_bytes=1).collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-12 for k in one)


@pytest.mark.parametrize("method", ["tfidf", "clusters"])
def test_documents_through_save_and_load(spark, sf, tmp_path, method):
    docs = fx.docs(spark, sf)
    wv = fx.word_vectors_meta(spark, sf)
    lex = fx.main_lexicon(spark, sf, wv)
    proc = fit_processor(docs, wv, fx.annotations(spark, sf), stopword_list(spark),
                         keep_words=lex.select(F.col("term").alias("word")), method=method)
    model = LexiconClassifier(wv, proc, n_models=2, multiplier=1, multiplier_outside=1).fit(
        lex, fx.support_lexicon(spark, sf, wv), ["c0", "c1"], ["c2", "c3"], fixed_params={"n_rff": 16})
    before = sorted(map(tuple, model.predict_docs_proba(docs).collect()))
    assert len(before) == 2 * docs.count()
    model.save(str(tmp_path / "model"))
    again = load_classifier(spark, str(tmp_path / "model"))
    after = sorted(map(tuple, again.predict_docs_proba(docs).collect()))
    assert [x[:2] for x in before] == [x[:2] for x in after]
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(before, after))
    flags = again.predict_docs(docs)
    assert flags.columns == ["doc_id", "c0", "c1"] and flags.count() == docs.count()
    # the same processor scores documents on the polarity scale
    fitted = LatentSemanticScaling(wv.select("word", "vec"), processor=proc).fit(fx.polarity_lexicon(spark, sf, wv), docs)
    fitted.save(str(tmp_path / "scale"))
    scaled = load_scaling(spark, str(tmp_path / "scale")).predict_docs(docs)
    r = scaled.agg(F.avg("polarity").alias("m"), F.count("polarity").alias("n")).first()
    assert abs(r["m"]) < 1e-6 and r["n"] == docs.count()
