"""Registered queries: latent semantic scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmesh.operators.lexicon import dedupe_last_weight
from lexmesh.operators.scaling import (LatentSemanticScaling, doc_polarity_allwords,
                                       fit_polarity_axis, fit_scaler, scale_scores,
                                       word_scores)
from lexmesh.operators.vectors import embed_lexicon
from lexmesh.plans import fixtures as fx
from lexmesh.plans.fixtures import with_fixtures
from lexmesh.plans.registry import register
from lexmesh.session import materialize

WS = r"'[ \t\n\r\f\x0b]+'"

_RAW_ALLWORDS = f"""
ws_tokens AS (SELECT doc_id, unnest(regexp_split_to_array(text, {WS})) AS word FROM documents),
tok_scores AS (SELECT t.doc_id, wp.pol FROM ws_tokens t JOIN word_pol wp ON wp.word = t.word),
raw AS (SELECT d.doc_id, avg(ts.pol) AS s FROM documents d
        LEFT JOIN tok_scores ts ON ts.doc_id = d.doc_id GROUP BY d.doc_id),
stats AS (SELECT avg(s) AS m, stddev_pop(s) AS sd FROM raw WHERE s IS NOT NULL)
"""


def _sql(body: str, extra: str = "") -> str:
    return with_fixtures(body, extra)


def fit_doc_scaling(spark, sf_dir, scaler="standard"):
    """Fit on the whole corpus; returns (model, scaled training scores)."""
    wvm = fx.word_vectors_meta(spark, sf_dir)
    est = LatentSemanticScaling(wvm.select("word", "vec"), method="allwords", scaler=scaler)
    return est.fit_transform(fx.polarity_lexicon(spark, sf_dir, wvm), fx.docs(spark, sf_dir))


@register("doc_polarity_allwords", sql=_sql(
    "SELECT doc_id, round((s - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS polarity "
    "FROM raw, stats", _RAW_ALLWORDS))
def q_doc_polarity_allwords(spark, sf_dir):
    """Flagship: scaled all-words document polarity over the whole corpus."""
    _, out = fit_doc_scaling(spark, sf_dir)
    return out.select("doc_id", F.round("polarity", 6).alias("polarity"))


# --- text cleaning (F1, F2) ------------------------------------------------------

from lexmesh.functions.rules import DEFAULT_RULES, sql_clean_expr, sql_remove_urls  # noqa: E402
from lexmesh.functions.text import apply_rules, remove_urls  # noqa: E402


@register("remove_urls", sql=(
    f"SELECT page_id, md5(c) AS cleaned_md5, length(c) AS n_chars FROM "
    f"(SELECT page_id, {sql_remove_urls('html')} AS c FROM pages)"))
def q_remove_urls(spark, d):
    pages = fx.table(spark, d, "pages")
    c = remove_urls(F.col("html"))
    return pages.select("page_id", F.md5(c).alias("cleaned_md5"), F.length(c).alias("n_chars"))


@register("clean_text", sql=(
    f"SELECT doc_id, md5(c) AS cleaned_md5, length(c) AS n_chars FROM "
    f"(SELECT doc_id, {sql_clean_expr('CAST(text AS VARCHAR)')} AS c FROM documents)"))
def q_clean_text(spark, d):
    docs = fx.table(spark, d, "documents")
    c = apply_rules(F.col("text").cast("string"), DEFAULT_RULES)
    return docs.select("doc_id", F.md5(c).alias("cleaned_md5"), F.length(c).alias("n_chars"))


# --- word / vector scores, scalers ---------------------------------------------------

_SCALED_WORDS = "SELECT word, round((pol - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS polarity FROM word_pol, stats"


@register("word_polarity", sql=_sql(_SCALED_WORDS, _RAW_ALLWORDS))
def q_word_polarity(spark, d):
    """Scaled polarity of every word with a vector."""
    model, _ = fit_doc_scaling(spark, d)
    out = model.predict_words(model.word_vectors.select("word"))
    return out.select("word", F.round("polarity", 6).alias("polarity"))


@register("vector_polarity", sql=_sql(
    "SELECT vec_id, round((s - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS polarity FROM "
    "(SELECT vec_id, sum(x / nrm * a) AS s FROM (SELECT vec_id, unnest(v) AS x, "
    "unnest(generate_series(1, len(v))) AS i, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS nrm "
    "FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)) JOIN axis USING (i) "
    "GROUP BY vec_id), stats", _RAW_ALLWORDS))
def q_vector_polarity(spark, d):
    """Scaled polarity of every row of ``embeddings`` as a raw vector (A10)."""
    model, _ = fit_doc_scaling(spark, d)
    vecs = fx.table(spark, d, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    return model.predict_vectors(vecs).select("vec_id", F.round("polarity", 6).alias("polarity"))


@register("fit_scaler", sql=_sql(
    "SELECT 'standard' AS kind, round(m, 6) AS center, round(sd, 6) AS scale FROM stats "
    "UNION ALL SELECT 'minmax', round(min(s), 6), round(max(s) - min(s), 6) FROM raw "
    "WHERE s IS NOT NULL", _RAW_ALLWORDS))
def q_fit_scaler(spark, d):
    model, _ = fit_doc_scaling(spark, d)
    raw = model.extras["training_scores"]
    rows = [fit_scaler(raw, kind=k) for k in ("standard", "minmax")]
    frame = rows[0].as_frame(spark).unionByName(rows[1].as_frame(spark))
    return frame.select("kind", F.round("center", 6).alias("center"),
                        F.round("scale", 6).alias("scale"))


@register("scale_scores", sql=_sql(
    "SELECT doc_id, round((s - mn) / CASE WHEN mx = mn THEN 1 ELSE mx - mn END, 6) AS polarity "
    "FROM raw, (SELECT min(s) AS mn, max(s) AS mx FROM raw)", _RAW_ALLWORDS))
def q_scale_scores(spark, d):
    """Min-max scaled all-words document polarity (F6 with a minmax scaler)."""
    _, out = fit_doc_scaling(spark, d, scaler="minmax")
    return out.select("doc_id", F.round("polarity", 6).alias("polarity"))


@register("custom_scaler", sql=_sql(
    "SELECT doc_id, round((s - mid) / CASE WHEN half = 0 THEN 1 ELSE half END, 6) AS polarity FROM raw, "
    "(SELECT (max(s) + min(s)) / 2 AS mid, (max(s) - min(s)) / 2 AS half "
    "FROM raw WHERE s IS NOT NULL)", _RAW_ALLWORDS))
def q_custom_scaler(spark, d):
    """A user-supplied scaler (X1): middle and half of the range, which are
    partial aggregates (an exact percentile would gather all scores)."""
    def half_range(scores):
        lo, hi = F.min("polarity"), F.max("polarity")
        return (hi + lo) / 2, (hi - lo) / 2
    _, out = fit_doc_scaling(spark, d, scaler=half_range)
    return out.select("doc_id", F.round("polarity", 6).alias("polarity"))


_PROBA = ("SELECT doc_id, 1.0 / (1.0 + exp(-((s - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END))) "
          "AS proba FROM raw, stats")


def _doc_proba(spark, d):
    _, scaled = fit_doc_scaling(spark, d)
    return scaled.select("doc_id", (1.0 / (1.0 + F.exp(-F.col("polarity")))).alias("proba"))


@register("threshold_predictions", sql=_sql(
    f"SELECT doc_id, CAST(proba >= 0.5 AS INTEGER) AS prediction FROM ({_PROBA})", _RAW_ALLWORDS))
def q_threshold_predictions(spark, d):
    """Classifier cutoff ``proba >= 0.5`` on logistic scaled polarity."""
    from lexmesh.operators.lexicon import threshold_predictions
    return threshold_predictions(_doc_proba(spark, d), 0.5).select("doc_id", "prediction")


@register("ensemble_predict", sql=_sql(
    f"SELECT doc_id, CAST(proba > 0.5 AS INTEGER) AS prediction FROM ({_PROBA})", _RAW_ALLWORDS))
def q_ensemble_predict(spark, d):
    """Ensemble cutoff ``proba > 0.5`` (P13); null score -> null."""
    from lexmesh.operators.lexicon import ensemble_predict
    return ensemble_predict(_doc_proba(spark, d), 0.5).select("doc_id", "prediction")


# --- J8, M14 -----------------------------------------------------------------------------

@register("word_seed_similarity", sql=_sql(
    "SELECT w.word, round(avg(list_inner_product(w.u, s.u)), 6) AS mean_cosine, "
    "round(avg(s.weight * list_inner_product(w.u, s.u)), 6) AS weighted_cosine "
    "FROM word_units w, seeds s GROUP BY w.word"))
def q_word_seed_similarity(spark, d):
    """Mean and weight-averaged cosine of every word to the seed set.

    Both are linear in the seed unit vectors, so each collapses to one
    dim-sized axis (R1): no word x seed pair is ever formed."""
    from lexmesh.operators.scaling import word_scores
    wvm = fx.word_vectors_meta(spark, d)
    wv = wvm.select("word", "vec")
    seeds = embed_lexicon(fx.polarity_lexicon(spark, d, wvm), wv)
    weighted = fit_polarity_axis(seeds)
    unweighted = fit_polarity_axis(seeds.withColumn("weight", F.lit(1.0)))
    a = word_scores(wv, weighted).withColumnRenamed("polarity", "weighted_cosine")
    b = word_scores(wv, unweighted).withColumnRenamed("polarity", "mean_cosine")
    return a.join(b, "word").select("word", F.round("mean_cosine", 6).alias("mean_cosine"),
                                    F.round("weighted_cosine", 6).alias("weighted_cosine"))


@register("fit_scaling", sql=_sql(
    "SELECT (SELECT count(*) FROM seeds) AS n_seeds, (SELECT count(*) FROM axis) AS dim, "
    "round(sqrt((SELECT sum(a * a) FROM axis)), 6) AS axis_norm, round(m, 6) AS center, "
    "round(sd, 6) AS scale FROM stats", _RAW_ALLWORDS))
def q_fit_scaling(spark, d):
    """The fitted scaling model's state (M14): seeds, axis and scaler."""
    model, _ = fit_doc_scaling(spark, d)
    ax = model.axis
    row = [(ax.n_seeds, ax.dim, round(sum(x * x for x in ax.axis) ** 0.5, 6),
            round(model.scaler.center, 6), round(model.scaler.scale, 6))]
    return spark.createDataFrame(row, "n_seeds long, dim int, axis_norm double, center double, "
                                      "scale double")
