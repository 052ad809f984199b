"""Registered queries: persistence round trips and batch / stream scoring
(S7, S9-S13, B1, B2)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from lexmesh.plans import fixtures as fx
from lexmesh.plans.fixtures import with_fixtures as W
from lexmesh.plans.q_scaling import _RAW_ALLWORDS, fit_doc_scaling
from lexmesh.plans.registry import register
from lexmesh.session import scratch_path
from lexmesh.sources import lexicon_io as IO
from lexmesh.sources import store as ST
from lexmesh.sources.binary_vectors import load_vectors, write_word2vec
from lexmesh.streaming.batch import score_in_batches, score_stream

_VEC_SQL = W("SELECT word, len(vec) AS dim, round(list_sum(vec), 6) AS vsum FROM word_vectors")
_DOC_SQL = W("SELECT doc_id, round((s - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS polarity "
             "FROM raw, stats", _RAW_ALLWORDS)


def _vec_summary(df):
    return df.select("word", F.size("vec").alias("dim"),
                     F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("vsum"))


@register("vectors_from_text", sql=_VEC_SQL)
def q_vectors_from_text(spark, d):
    path = scratch_path(spark, "vectors-text")
    ST.write_vectors_text(fx.word_vectors(spark, d), path)
    return _vec_summary(ST.vectors_from_text(spark, path))


@register("vectors_from_binary", sql=_VEC_SQL)
def q_vectors_from_binary(spark, d):
    """Word vectors through binary word2vec files, read by byte ranges."""
    path = scratch_path(spark, "vectors-binary")
    write_word2vec(fx.word_vectors(spark, d), path)
    return _vec_summary(load_vectors(spark, path, "word2vec"))


@register("save_vectors", sql=_VEC_SQL)
def q_save_vectors(spark, d):
    path = scratch_path(spark, "vectors")
    ST.save_vectors(fx.word_vectors(spark, d), path)
    return _vec_summary(ST.load_vectors_filtered(spark, path))


@register("save_lexicon", sql=W("SELECT category, pos, term FROM category_lexicon"))
def q_save_lexicon(spark, d):
    path = scratch_path(spark, "lexicon")
    IO.save_lexicon(fx.category_lexicon(spark, d), path, kind="category")
    return IO.load_lexicon(spark, path, kind="category")


@register("save_tfidf", sql=W("SELECT word, df, round(idf, 6) AS idf FROM vocab"))
def q_save_tfidf(spark, d):
    from lexmesh.plans.q_tfidf import fitted_tfidf
    model, _ = fitted_tfidf(spark, d)
    path = scratch_path(spark, "tfidf")
    ST.save_tfidf(spark, model, path)
    loaded = ST.load_tfidf(spark, path)
    return loaded.vocab.select("word", "df", F.round("idf", 6).alias("idf"))


def _cluster_sql():
    from lexmesh.plans.q_clusters import _sql as cluster_sql
    return cluster_sql("SELECT word, cluster_id FROM clusters")


@register("save_clusters", sql=_cluster_sql())
def q_save_clusters(spark, d):
    from lexmesh.plans.q_clusters import _Fitted
    path = scratch_path(spark, "clusters")
    ST.save_clusters(_Fitted(spark, d).clusters(), path)
    return ST.load_clusters(spark, path)


@register("save_model")
def q_save_model(spark, d):
    """Save the fitted classifier members and reload them to score."""
    from lexmesh.operators.ensemble import predict_proba
    from lexmesh.plans.q_models import MAIN, fitted_models
    path = scratch_path(spark, "model")
    ST.save_model(spark, path, fitted_models(spark, d, n_models=2),
                  {"kind": "classifier", "main_keys": MAIN})
    tables, params = ST.load_model(spark, path, ["members"])
    wv = fx.word_vectors_meta(spark, d).select("word", "vec")
    return predict_proba(wv, tables["members"], id_cols=("word",)) \
        .where(F.col("category").isin(params["main_keys"]))


@register("score_in_batches", sql=_DOC_SQL)
def q_score_in_batches(spark, d):
    """Scaled document polarity scored in 10 resumable hash batches (B1)."""
    model, _ = fit_doc_scaling(spark, d)
    out = scratch_path(spark, "batches")
    res = score_in_batches(spark, fx.docs(spark, d), model.predict_docs, out, n_batches=10)
    return res.select("doc_id", F.round("polarity", 6).alias("polarity"))


@register("score_stream", sql=_DOC_SQL)
def q_score_stream(spark, d):
    """The same scorer over documents arriving as files (B2)."""
    model, _ = fit_doc_scaling(spark, d)
    base = scratch_path(spark, "stream")
    inbox = os.path.join(base, "in")
    docs = fx.docs(spark, d)
    docs.repartition(4).write.mode("overwrite").parquet(inbox)   # the arriving files
    score_stream(spark, inbox, docs.schema, model.predict_docs, os.path.join(base, "out"),
                 os.path.join(base, "checkpoint"), max_files_per_trigger=2)
    res = spark.read.parquet(os.path.join(base, "out"))
    return res.select("doc_id", F.round("polarity", 6).alias("polarity"))
