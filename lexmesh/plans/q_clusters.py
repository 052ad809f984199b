"""Registered queries: word clusters and cluster tf-idf (C1-C5, N6, N7, A12),
and the tf-idf document-vector polarity path (A5 · axis)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmesh.functions.vectors import norm
from lexmesh.operators import clusters as C
from lexmesh.operators import docvec as D
from lexmesh.operators.processor import fit_processor
from lexmesh.operators.scaling import LatentSemanticScaling, fit_polarity_axis, fit_scaler, scale_scores
from lexmesh.operators.tokens import stopword_list
from lexmesh.operators.vectors import embed_lexicon
from lexmesh.plans import fixtures as fx
from lexmesh.plans.fixtures import with_fixtures
from lexmesh.plans.q_tfidf import fitted_tfidf
from lexmesh.plans.registry import oracle, register
from lexmesh.session import materialize

N_WORDS = 40000
THRESHOLD = 0.5
N_TOP = 3

_CLUSTER_CTES = f"""
cwords AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx FROM (SELECT word FROM vocab
           WHERE word IN (SELECT word FROM word_vectors) ORDER BY df DESC, word LIMIT {N_WORDS})),
cunits AS (SELECT c.word, c.idx, u.u FROM cwords c JOIN word_units u ON u.word = c.word),
sim_pairs AS (SELECT * FROM (SELECT a.word AS word_a, b.word AS word_b,
              list_inner_product(a.u, b.u) AS cosine FROM cunits a JOIN cunits b ON a.idx < b.idx)
              WHERE cosine >= {1.0 - THRESHOLD}),
edges AS (SELECT word_a AS s, word_b AS t FROM sim_pairs UNION ALL SELECT word_b, word_a FROM sim_pairs),
reach(word, root) AS (SELECT word, word FROM cwords UNION
                      SELECT e.t, r.root FROM reach r JOIN edges e ON e.s = r.word),
clusters AS (SELECT c.word, w.idx AS cluster_id FROM (SELECT word, min(root) AS root FROM reach
             GROUP BY word) c JOIN cwords w ON w.word = c.root),
crow AS (SELECT t.doc_id, c.cluster_id, t.word, t.weight FROM tfidf t JOIN clusters c ON c.word = t.word),
cagg AS (SELECT doc_id, cluster_id, sum(weight) AS weight FROM crow GROUP BY doc_id, cluster_id),
cvec AS (SELECT r.doc_id, r.cluster_id, e.i, sum(r.weight * e.x) / sum(r.weight) AS value FROM crow r
         JOIN (SELECT word, unnest(vec) AS x, unnest(generate_series(0, len(vec) - 1)) AS i
               FROM word_vectors) e ON e.word = r.word GROUP BY r.doc_id, r.cluster_id, e.i),
cranked AS (SELECT doc_id, cluster_id, weight, row_number() OVER (PARTITION BY doc_id
            ORDER BY round(weight, {C.TIE_DIGITS}) DESC, cluster_id) AS rnk FROM cagg),
ctop AS (SELECT doc_id, cluster_id, rnk, weight / sum(weight) OVER (PARTITION BY doc_id) AS weight
         FROM cranked WHERE rnk <= {N_TOP}),
cstats AS (SELECT doc_id, cluster_id, sum(value) AS vsum, sqrt(sum(value * value)) AS vnorm
           FROM cvec GROUP BY doc_id, cluster_id),
cdocpol AS (SELECT t.doc_id, sum(t.weight * p.pol) AS s FROM ctop t JOIN
            (SELECT v.doc_id, v.cluster_id, CASE WHEN st.vnorm = 0 THEN 0 ELSE
             sum(v.value * a.a) / st.vnorm END AS pol FROM cvec v JOIN axis a ON a.i = v.i + 1
             JOIN cstats st ON st.doc_id = v.doc_id AND st.cluster_id = v.cluster_id
             GROUP BY v.doc_id, v.cluster_id, st.vnorm) p
            ON p.doc_id = t.doc_id AND p.cluster_id = t.cluster_id GROUP BY t.doc_id),
craw AS (SELECT d.doc_id, coalesce(c.s, 0.0) AS s FROM documents d LEFT JOIN cdocpol c ON c.doc_id = d.doc_id),
cst AS (SELECT avg(s) AS m, stddev_pop(s) AS sd FROM craw)
"""


def _sql(body: str) -> str:
    return with_fixtures(body, _CLUSTER_CTES, recursive=True, instead=fx.SQL_GROUPED)


class _Fitted:
    """The fitted processor shared by the cluster queries (R4: fit once)."""

    def __init__(self, spark, d):
        self.wv = fx.grouped_vectors(spark, d)
        self.model, toks = fitted_tfidf(spark, d)
        self.toks = toks
        self.words = materialize(C.vocab_top_n_words(self.model.vocab, self.wv, N_WORDS))
        self.wvv = self.wv.select("word", "vec")

    def pairs(self):
        return materialize(C.similar_word_pairs(self.words, self.wvv, THRESHOLD))

    def forest(self):
        return C.similarity_forest(self.words, self.wvv, THRESHOLD)

    def clusters(self):
        return C.cut_forest(self.words, self.forest(), THRESHOLD)

    def doc_clusters(self, share=None):
        return C.doc_clusters(self.model.transform(self.toks), self.clusters(), self.wvv, N_TOP, share)


@register("vocab_top_n_words", sql=_sql("SELECT word, idx FROM cwords"))
def q_vocab_top_n_words(spark, d):
    return _Fitted(spark, d).words


@register("similar_word_pairs", sql=_sql(
    "SELECT word_a, word_b, round(cosine, 6) AS cosine FROM sim_pairs"))
def q_similar_word_pairs(spark, d):
    return _Fitted(spark, d).pairs().withColumn("cosine", F.round("cosine", 6))


@register("cluster_words", sql=_sql("SELECT word, cluster_id FROM clusters"))
def q_cluster_words(spark, d):
    return _Fitted(spark, d).clusters()


@register("cluster_cut", sql=with_fixtures(
    "SELECT word, cluster_id FROM clusters", _CLUSTER_CTES.replace(f"cosine >= {1.0 - THRESHOLD}", "cosine >= 0.7"),
    recursive=True, instead=fx.SQL_GROUPED))
def q_cluster_cut(spark, d):
    """The dendrogram fitted for one threshold, cut at a closer one without a refit."""
    fit = _Fitted(spark, d)
    return C.cut_forest(fit.words, fit.forest(), 0.3)


def _cluster_summary(dc):
    return dc.select("doc_id", "cluster_id", "rank", F.round("weight", 6).alias("weight"),
                     F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("vsum"),
                     F.round(norm("vec"), 6).alias("vnorm"))


@register("doc_clusters", sql=_sql(
    "SELECT t.doc_id, t.cluster_id, t.rnk AS rank, round(t.weight, 6) AS weight, "
    "round(s.vsum, 6) AS vsum, round(s.vnorm, 6) AS vnorm FROM ctop t JOIN cstats s "
    "ON s.doc_id = t.doc_id AND s.cluster_id = t.cluster_id"))
def q_doc_clusters(spark, d):
    return _cluster_summary(_Fitted(spark, d).doc_clusters())


@register("top_clusters_per_doc", sql=_sql(
    "SELECT doc_id, cluster_id, rnk AS rank FROM ctop"))
def q_top_clusters_per_doc(spark, d):
    return _Fitted(spark, d).doc_clusters().select("doc_id", "cluster_id", "rank")


@register("cluster_share_filter", sql=_sql(
    "SELECT doc_id, cluster_id, round(weight / sum(weight) OVER (PARTITION BY doc_id), 6) AS weight "
    "FROM (SELECT doc_id, cluster_id, rnk, weight FROM (SELECT doc_id, cluster_id, rnk, weight, "
    "weight / sum(weight) OVER (PARTITION BY doc_id) AS share FROM cranked WHERE rnk <= 3) "
    "WHERE share >= 0.2 OR rnk = 1)"))
def q_cluster_share_filter(spark, d):
    dc = _Fitted(spark, d).doc_clusters(share=0.2)
    return dc.select("doc_id", "cluster_id", F.round("weight", 6).alias("weight"))


@register("doc_vectors_clusters", sql=_sql(
    "SELECT d.doc_id, p.i AS pos, round(coalesce(e.value, 0.0), 6) AS value FROM documents d "
    "JOIN (SELECT unnest(generate_series(0, dim - 1)) AS i FROM dim) p ON true "
    "LEFT JOIN (SELECT t.doc_id, v.i, sum(t.weight * v.value) AS value FROM ctop t JOIN cvec v "
    "ON v.doc_id = t.doc_id AND v.cluster_id = t.cluster_id GROUP BY t.doc_id, v.i) e "
    "ON e.doc_id = d.doc_id AND e.i = p.i"))
def q_doc_vectors_clusters(spark, d):
    fit = _Fitted(spark, d)
    dim = fit.wv.agg(F.max(F.size("vec"))).first()[0]
    return D.explode_vectors(C.doc_vectors_clusters(fit.doc_clusters(), docs=fx.docs(spark, d), dim=dim))


def _axis(spark, d, wv):
    seeds = embed_lexicon(fx.polarity_lexicon(spark, d, wv), wv.select("word", "vec"))
    return fit_polarity_axis(seeds)


@register("doc_polarity_clusters", sql=_sql(
    "SELECT doc_id, round((s - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS polarity "
    "FROM craw, cst"))
def q_doc_polarity_clusters(spark, d):
    """Scaled cluster-path document polarity (A12); no cluster -> 0."""
    from lexmesh.operators.scaling import doc_polarity_clusters
    fit = _Fitted(spark, d)
    axis = _axis(spark, d, fit.wv)
    per_doc = doc_polarity_clusters(fit.doc_clusters(), axis)
    raw = materialize(fx.docs(spark, d).select("doc_id").join(per_doc, "doc_id", "left")
                      .withColumn("polarity", F.coalesce("polarity", F.lit(0.0))))
    out = scale_scores(raw, fit_scaler(raw))
    return out.select("doc_id", F.round("polarity", 6).alias("polarity"))


@register("doc_polarity_tfidf", sql=with_fixtures(
    "SELECT doc_id, round((s - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS polarity FROM tr, ts",
    """tpol AS (SELECT e.doc_id, CASE WHEN n.dn = 0 THEN 0 ELSE sum(e.value * a.a) / n.dn END AS s
               FROM docvec e JOIN axis a ON a.i = e.pos + 1 JOIN (SELECT doc_id,
               sqrt(sum(value * value)) AS dn FROM docvec GROUP BY doc_id) n ON n.doc_id = e.doc_id
               GROUP BY e.doc_id, n.dn),
       tr AS (SELECT doc_id, s FROM tpol),
       ts AS (SELECT avg(s) AS m, stddev_pop(s) AS sd FROM tr)"""))
def q_doc_polarity_tfidf(spark, d):
    """tf-idf path without clusters (the reference raises there, Q6):
    polarity of the top-3 tf-idf-weighted document vector, scaled."""
    from lexmesh.operators.scaling import doc_polarity_vectors
    wv = fx.word_vectors_meta(spark, d)
    model, toks = fitted_tfidf(spark, d)
    dim = wv.agg(F.max(F.size("vec"))).first()[0]
    vecs = D.doc_vectors_weighted(model.transform(toks), wv.select("word", "vec"), n_top=3,
                                  docs=fx.docs(spark, d), dim=dim)
    raw = materialize(doc_polarity_vectors(vecs, _axis(spark, d, wv)))
    out = scale_scores(raw, fit_scaler(raw))
    return out.select("doc_id", F.round("polarity", 6).alias("polarity"))


def _processor(spark, d, method):
    """The fitted processor itself, with the lexicon's words kept beside the vocabulary."""
    wv = fx.grouped_vectors(spark, d) if method == "clusters" else fx.word_vectors_meta(spark, d)
    lex = fx.category_lexicon(spark, d, wv=wv).select(F.col("term").alias("word"))
    return wv, fit_processor(fx.table(spark, d, "documents"), wv, fx.annotations(spark, d), stopword_list(spark),
                             keep_words=lex, method=method, n_words=N_WORDS, distance_threshold=THRESHOLD,
                             n_top_clusters=N_TOP, n_top_words=3)


@register("fit_processor", sql=_sql(
    "SELECT coalesce(v.word, w.word) AS word, v.df, round(v.idf, 6) AS idf, c.cluster_id, "
    "round(list_sum(w.vec), 6) AS vsum FROM vocab v FULL JOIN (SELECT word, vec FROM word_vectors "
    "WHERE word IN (SELECT word FROM vocab UNION SELECT term FROM category_lexicon)) w ON w.word = v.word "
    "LEFT JOIN clusters c ON c.word = v.word"))
def q_fit_processor(spark, d):
    """The fitted document processor's state (M15): vocabulary, the vectors kept
    for vocabulary and lexicon (J2 over U2), and word clusters."""
    _, p = _processor(spark, d, "clusters")
    vsum = F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("vsum")
    kept = p.word_vectors.select("word", vsum)
    return p.tfidf.vocab.select("word", "df", F.round("idf", 6).alias("idf")).join(kept, "word", "full") \
        .join(p.clusters, "word", "left").select("word", "df", "idf", "cluster_id", "vsum")


def _scaled_docs(spark, d, method):
    wv, p = _processor(spark, d, method)
    est = LatentSemanticScaling(wv.select("word", "vec"), processor=p)
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    model = est.fit(fx.polarity_lexicon(spark, d, wv), docs)
    return model.predict_docs(docs).select("doc_id", F.round("polarity", 6).alias("polarity"))


@register("scaling_docs_tfidf", sql=oracle("doc_polarity_tfidf"))
def q_scaling_docs_tfidf(spark, d):
    """Scaling by top tf-idf words through the estimator (M14 with M15): fitted, then asked for the documents."""
    return _scaled_docs(spark, d, "tfidf")


@register("scaling_docs_clusters", sql=oracle("doc_polarity_clusters"))
def q_scaling_docs_clusters(spark, d):
    """Scaling by word clusters through the estimator (M14 with M15)."""
    return _scaled_docs(spark, d, "clusters")


def _classified_docs(spark, d, method):
    from lexmesh.operators.classifier import LexiconClassifier
    wv, p = _processor(spark, d, method)
    est = LexiconClassifier(wv, processor=p, n_models=2, multiplier=2, multiplier_outside=2)
    model = est.fit(fx.main_lexicon(spark, d, wv), fx.support_lexicon(spark, d, wv), ["c0", "c1"], ["c2", "c3"])
    return model, fx.table(spark, d, "documents").select("doc_id", "text")


@register("predict_docs_proba")
def q_predict_docs_proba(spark, d):
    """Probability of each main category for every document through the estimator (M9)."""
    model, docs = _classified_docs(spark, d, "tfidf")
    return model.predict_docs_proba(docs)


@register("predict_docs_clusters")
def q_predict_docs_clusters(spark, d):
    """Flags of every document by its top word clusters through the estimator (M9, C4)."""
    model, docs = _classified_docs(spark, d, "clusters")
    return model.predict_docs(docs)


@register("saved_pipeline", sql=oracle("doc_polarity_tfidf"))
def q_saved_pipeline(spark, d):
    """A Spark ML pipeline of document vectors and seed polarity: fitted, saved, loaded
    again and asked for the documents (P11, M14, M15, S13)."""
    from pyspark.ml import Pipeline, PipelineModel
    from lexmesh.operators import ml
    from lexmesh.session import scratch_path
    base, wv = scratch_path(spark, "pipeline"), fx.word_vectors_meta(spark, d)
    given = {"vectors": wv.select("word", "vec"), "annotations": fx.annotations(spark, d),
             "seeds": fx.polarity_lexicon(spark, d, wv)}
    for name, df in given.items():
        df.write.parquet(f"{base}/{name}")
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    stages = [ml.DocumentVectorizer(wordVectors=f"{base}/vectors", annotations=f"{base}/annotations"),
              ml.SeedPolarity(wordVectors=f"{base}/vectors", seeds=f"{base}/seeds")]
    Pipeline(stages=stages).fit(docs).write().save(f"{base}/model")
    out = PipelineModel.load(f"{base}/model").transform(docs)
    return out.select("doc_id", F.round("polarity", 6).alias("polarity"))


@register("linear_predict_docs", sql=lambda: with_fixtures(
    "SELECT doc_id, CAST(max(proba) FILTER (category = 'c0') >= 0.5 AS INTEGER) AS c0, "
    "CAST(max(proba) FILTER (category = 'c1') >= 0.5 AS INTEGER) AS c1 FROM (SELECT doc_id, category, avg(p) AS proba "
    "FROM (SELECT doc_id, category, param_id, avg(1.0 / (1.0 + exp(-4.0 * f))) AS p FROM doc_scores "
    "GROUP BY doc_id, category, param_id) GROUP BY doc_id, category) GROUP BY doc_id",
    _linear_ctes() + """, doc_scores AS (SELECT e.doc_id, m.category, m.param_id, m.model_ix, sum(e.value * m.x) AS f
    FROM docvec e JOIN (SELECT category, param_id, model_ix, unnest(vec) AS x,
    unnest(generate_series(0, len(vec) - 1)) AS i FROM members) m ON m.i = e.pos
    GROUP BY e.doc_id, m.category, m.param_id, m.model_ix)""")())
def q_linear_predict_docs(spark, d):
    """Flags of every document through the fitted processor and classifier (M9, P12), with
    members of given coefficients."""
    from lexmesh.operators.classifier import ClassifierModel
    from lexmesh.plans.q_models import linear_members
    wv, p = _processor(spark, d, "tfidf")
    model = ClassifierModel(linear_members(spark, d), ["c0", "c1"], p, p.word_vectors, p.dim)
    return model.predict_docs(fx.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "c0", "c1")


def _linear_ctes() -> str:
    from lexmesh.plans.q_models import _LINEAR_CTES
    return _LINEAR_CTES.strip()
