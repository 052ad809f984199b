"""Spark ML stages: a pipeline equals its parts, and a saved one scores in a new session."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.param import Param
from pyspark.sql import functions as F

from lexmesh.operators import ml
from lexmesh.plans import fixtures as fx

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def given(spark, sf, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("given"))
    wv = fx.grouped_vectors(spark, sf)
    tables = {"vectors": wv.select("word", "vec"), "annotations": fx.annotations(spark, sf), "main": fx.main_lexicon(spark, sf, wv),
              "support": fx.support_lexicon(spark, sf, wv), "seeds": fx.polarity_lexicon(spark, sf, wv)}
    for name, df in tables.items():
        df.write.parquet(f"{base}/{name}")
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"), "lang")
    return base, docs


def stages(base, method):
    shared = {"idCol": "id", "wordVectors": f"{base}/vectors"}
    return [ml.DocumentVectorizer(textCol="body", annotations=f"{base}/annotations", method=method, **shared),
            ml.SeedPolarity(seeds=f"{base}/seeds", **shared),
            ml.LexiconDocumentClassifier(lexicon=f"{base}/main", support=f"{base}/support", mainKeys=["c0", "c1"],
                                         supportKeys=["c2", "c3"], nModels=2, multiplier=1, multiplierOutside=1, **shared)]


def rows(df):
    out = [(r.id, r.lang, round(r.polarity, 6), {k: round(v, 6) for k, v in r.proba.items()}, r.c0, r.c1) for r in df.collect()]
    return sorted(out, key=lambda r: r[0])


@pytest.mark.parametrize("method", ["tfidf", "clusters"])
def test_saved_pipeline_scores_after_loading_in_a_new_session(spark, given, tmp_path, method):
    base, docs = given
    model = Pipeline(stages=stages(base, method)).fit(docs)
    out = model.transform(docs)
    assert out.columns == ["id", "body", "lang", "vec", "polarity", "proba", "c0", "c1"]
    want = rows(out)
    assert len(want) == docs.count() and all(f == int(p >= .5) for r in want for p, f in zip(r[3].values(), r[4:]))
    model.write().overwrite().save(f"{tmp_path}/model")
    assert rows(PipelineModel.load(f"{tmp_path}/model").transform(docs)) == want
    if method == "tfidf":
        docs.write.parquet(f"{tmp_path}/docs")
        code = (f"import sys, json; sys.path[:0] = [{REPO!r}, {REPO + '/tests'!r}]\n"
                "from lexmesh.session import local_session\nfrom pyspark.ml import PipelineModel\nfrom test_ml import rows\n"
                "spark = local_session(cores=2, shuffle_partitions=3, driver_memory='2g')\n"
                f"model = PipelineModel.load({str(tmp_path) + '/model'!r})\n"
                f"got = rows(model.transform(spark.read.parquet({str(tmp_path) + '/docs'!r})))\n"
                f"open({str(tmp_path) + '/got'!r}, 'w').write(json.dumps(got))\n")
        done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, cwd=tmp_path)
        assert done.returncode == 0, done.stderr[-3000:]
        assert json.load(open(f"{tmp_path}/got")) == json.loads(json.dumps(want))


def test_stages_equal_the_plain_classes(spark, given):
    from lexmesh.operators.processor import fit_processor
    from lexmesh.operators.scaling import LatentSemanticScaling
    from lexmesh.operators.tokens import stopword_list
    base, docs = given
    plain_docs = docs.select(F.col("id").alias("doc_id"), F.col("body").alias("text"))
    read = spark.read.parquet
    p = fit_processor(plain_docs, read(f"{base}/vectors"), read(f"{base}/annotations"), stopword_list(spark))
    want = LatentSemanticScaling(read(f"{base}/vectors"), processor=p).fit(read(f"{base}/seeds"), plain_docs).predict_docs(plain_docs)
    got = Pipeline(stages=stages(base, "tfidf")[:2]).fit(docs).transform(docs)
    assert {r.id: round(r.polarity, 6) for r in got.collect()} == {r.doc_id: round(r.polarity, 6) for r in want.collect()}


def test_unfitted_stages_and_params(spark, given, tmp_path):
    base, docs = given
    est = stages(base, "tfidf")[0]
    for stage in stages(base, "tfidf"):
        assert not hasattr(stage, "transform")  # only fitted models have it (P11)
        assert all(isinstance(p, Param) for p in stage.params)
    other = est.copy({est.nTopWords: 7})
    assert other.getOrDefault("nTopWords") == 7 and est.getOrDefault("nTopWords") == 3
    est.write().overwrite().save(f"{tmp_path}/est")
    again = ml.DocumentVectorizer.load(f"{tmp_path}/est")
    assert {p.name: again.getOrDefault(p) for p in again.params if again.isDefined(p)} == \
        {p.name: est.getOrDefault(p) for p in est.params if est.isDefined(p)}
    with pytest.raises(TypeError):
        ml.DocumentVectorizer(minDf="many")
