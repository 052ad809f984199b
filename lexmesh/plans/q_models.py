"""Registered queries: training rows, augmentation, ensembles, tuning
(J4, J5, J9, M1-M13, A13-A16, N3, N4, X2, X3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmesh.functions.hashing import hash_u, sql_hash_slice, sql_hash_u
from lexmesh.functions.vectors import norm
from lexmesh.operators import augment as AU
from lexmesh.operators import ensemble as EN
from lexmesh.operators import tuning as TU
from lexmesh.operators.covariance import covariances
from lexmesh.operators.lexicon import threshold_predictions, wide_predictions
from lexmesh.plans import fixtures as fx
from lexmesh.plans.fixtures import with_fixtures
from lexmesh.plans.q_lexicon import SQL_BENCH_WORDS
from lexmesh.plans.registry import register
from lexmesh.session import materialize

MAIN, SUPPORT = ["c0", "c1"], ["c2", "c3"]
N_MODELS, MULT, MULT_OUT = 10, 5, 5
GRID = [{"kernel": ["rbf", "linear"], "n_models": [2], "pca": [0.25, None], "svc_c": [0.25, 4.0]}]

_TRAIN_CTES = f"""
emb AS (SELECT l.category, l.pos, replace(l.term, '*', '') AS term, w.vec FROM category_lexicon l
        JOIN word_vectors w ON w.word = replace(l.term, '*', '')),
embr AS (SELECT *, row_number() OVER (ORDER BY category, pos, term) - 1 AS row_id FROM emb),
tin AS (SELECT category, row_id, term, true AS inside, CAST(NULL AS VARCHAR) AS src_category, vec
        FROM embr WHERE category IN ('c0', 'c1')),
tout AS (SELECT m.category, e.row_id, e.term, false AS inside, e.category AS src_category, e.vec
         FROM embr e JOIN (VALUES ('c0'), ('c1')) m(category) ON m.category <> e.category
         WHERE e.category IN ('c0', 'c1', 'c2', 'c3')
         AND NOT EXISTS (SELECT 1 FROM tin i WHERE i.category = m.category AND i.term = e.term)),
training AS (SELECT * FROM tin UNION ALL SELECT * FROM tout),
tr_in AS (SELECT category, row_id, vec, row_number() OVER (PARTITION BY category ORDER BY row_id) - 1
          AS pool_pos, count(*) OVER (PARTITION BY category) AS n_pool FROM training WHERE inside),
reqs AS (SELECT category, s AS sample_id, category || '|-1|in|' || CAST(s AS VARCHAR) AS sample_key,
         n_pool FROM (SELECT category, n_pool, unnest(generate_series(0, n_pool * {MULT} - 1)) AS s
         FROM (SELECT DISTINCT category, n_pool FROM tr_in))),
chosen AS (SELECT sample_key, i, (c // [1, 11, 121][CAST(i AS INTEGER) + 1]) % 11 AS w FROM (SELECT sample_key,
           {sql_hash_u("'0'", 'sample_key', "'w'", "'0'")} % 1330 + 1 AS c FROM reqs), range(3) ii(i)),
draws AS (SELECT r.category, r.sample_id, c.i, c.w,
          CASE c.i WHEN 0 THEN {sql_hash_slice(0, "'0'", 'r.sample_key', "'ix'")}
                   WHEN 1 THEN {sql_hash_slice(1, "'0'", 'r.sample_key', "'ix'")}
                   ELSE {sql_hash_slice(2, "'0'", 'r.sample_key', "'ix'")} END % r.n_pool AS pool_pos
          FROM reqs r JOIN chosen c ON c.sample_key = r.sample_key),
combo AS (SELECT d.category, d.sample_id, e.j, sum(d.w * e.x) / sum(d.w) AS value FROM draws d
          JOIN (SELECT category, pool_pos, unnest(vec) AS x, unnest(generate_series(0, len(vec) - 1)) AS j
                FROM tr_in) e ON e.category = d.category AND e.pool_pos = d.pool_pos
          GROUP BY d.category, d.sample_id, e.j)
"""


_OUT_CTES = f"""
tout_pool AS (SELECT category, src_category, vec, row_number() OVER (PARTITION BY category, src_category
              ORDER BY row_id) - 1 AS pool_pos, count(*) OVER (PARTITION BY category, src_category)
              AS n_pool FROM training WHERE NOT inside),
srcs AS (SELECT category, src_category, row_number() OVER (PARTITION BY category ORDER BY src_category) - 1
         AS src_rank, count(*) OVER (PARTITION BY category) AS n_src
         FROM (SELECT DISTINCT category, src_category FROM training WHERE NOT inside)),
oreq0 AS (SELECT category, model_ix, unnest(generate_series(0, n * {MULT * MULT_OUT} - 1)) AS sample_id
          FROM (SELECT t.category, count(*) AS n FROM tin t GROUP BY t.category), range({N_MODELS}) m(model_ix)),
oreq AS (SELECT o.category, o.model_ix, o.sample_id, s.src_category, p.n_pool, o.sample_key FROM
         (SELECT *, category || '|' || CAST(model_ix AS VARCHAR) || '|out|' || CAST(sample_id AS VARCHAR)
          AS sample_key FROM oreq0) o
         JOIN (SELECT DISTINCT category, n_src FROM srcs) ns ON ns.category = o.category
         JOIN srcs s ON s.category = o.category
              AND s.src_rank = {sql_hash_u("'0'", 'o.sample_key', "'cat'")} % ns.n_src
         JOIN (SELECT DISTINCT category, src_category, n_pool FROM tout_pool) p
              ON p.category = o.category AND p.src_category = s.src_category),
ochosen AS (SELECT sample_key, i, (c // [1, 11, 121][CAST(i AS INTEGER) + 1]) % 11 AS w FROM (SELECT sample_key,
            {sql_hash_u("'0'", 'sample_key', "'w'", "'0'")} % 1330 + 1 AS c FROM oreq), range(3) ii(i)),
odraws AS (SELECT r.category, r.model_ix, r.sample_id, r.src_category, c.w,
           CASE c.i WHEN 0 THEN {sql_hash_slice(0, "'0'", 'r.sample_key', "'ix'")}
                    WHEN 1 THEN {sql_hash_slice(1, "'0'", 'r.sample_key', "'ix'")}
                    ELSE {sql_hash_slice(2, "'0'", 'r.sample_key', "'ix'")} END % r.n_pool AS pool_pos
           FROM oreq r JOIN ochosen c ON c.sample_key = r.sample_key),
ocombo AS (SELECT d.category, d.model_ix, d.sample_id, d.src_category, e.j,
           sum(d.w * e.x) / sum(d.w) AS value FROM odraws d
           JOIN (SELECT category, src_category, pool_pos, unnest(vec) AS x,
                 unnest(generate_series(0, len(vec) - 1)) AS j FROM tout_pool) e
           ON e.category = d.category AND e.src_category = d.src_category AND e.pool_pos = d.pool_pos
           GROUP BY d.category, d.model_ix, d.sample_id, d.src_category, e.j)
"""


def _sql(body, extra=""):
    return with_fixtures(body, _TRAIN_CTES + ("," + extra if extra else ""))


def training_table(spark, d):
    wv = fx.word_vectors_meta(spark, d)
    emb = AU.embedded_lexicon(fx.main_lexicon(spark, d, wv), wv.select("word", "vec"),
                              fx.support_lexicon(spark, d, wv))
    return materialize(AU.training_rows(emb, MAIN, SUPPORT))


@register("training_rows", sql=_sql(
    "SELECT category, row_id, term, inside, src_category, round(list_sum(vec), 6) AS vsum "
    "FROM training"))
def q_training_rows(spark, d):
    t = training_table(spark, d)
    return t.select("category", "row_id", "term", "inside", "src_category",
                    F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("vsum"))


@register("outside_terms", sql=_sql("SELECT category, term, src_category FROM tout"))
def q_outside_terms(spark, d):
    return AU.outside_terms(training_table(spark, d))


@register("training_union", sql=_sql(
    "SELECT category, inside, count(*) AS n FROM training GROUP BY category, inside"))
def q_training_union(spark, d):
    return training_table(spark, d).groupBy("category", "inside").agg(F.count(F.lit(1)).alias("n"))


_SPLIT_U = sql_hash_u("'0'", "category", "row_id", "'split'")


@register("train_test_split", sql=_sql(
    f"SELECT category, row_id, {_SPLIT_U} % 1000000 < 200000 AS is_test FROM training"))
def q_train_test_split(spark, d):
    return AU.train_test_split(training_table(spark, d), 0.2, seed=0) \
             .select("category", "row_id", "is_test")


@register("class_balance_weights", sql=_sql(
    "SELECT category, row_id, round(count(*) OVER (PARTITION BY category) / "
    "(2.0 * count(*) OVER (PARTITION BY category, inside)), 6) AS class_weight FROM training"))
def q_class_balance_weights(spark, d):
    out = EN.class_balance_weights(training_table(spark, d))
    return out.select("category", "row_id", F.round("class_weight", 6).alias("class_weight"))


def ensemble_set(spark, d, n_models=N_MODELS):
    return AU.ensemble_training_set(training_table(spark, d), n_models, MULT, MULT_OUT, seed=0)


@register("augment_sample", sql=_sql(
    "SELECT category, sample_id, round(sum(value), 6) AS vsum, "
    "round(sqrt(sum(value * value)), 6) AS vnorm FROM combo GROUP BY category, sample_id"))
def q_augment_sample(spark, d):
    """Inside convex samples of every main category (M1)."""
    s = ensemble_set(spark, d).where(F.col("inside") & (F.col("kind") == "sample"))
    return s.select("category", "sample_id",
                    F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("vsum"),
                    F.round(norm("vec"), 6).alias("vnorm"))


# rows and sums of all vector elements of a class-wise set, and of a member's whole set
_CLASS_CTES = f"""
class_rows AS (
  SELECT category, -1 AS model_ix, true AS inside, 'sample' AS kind, sample_id, sum(value) AS vsum
  FROM combo GROUP BY category, sample_id
  UNION ALL SELECT category, -1, true, 'original', row_id, list_sum(vec) FROM tin
  UNION ALL SELECT category, model_ix, false, 'sample', sample_id, sum(value)
  FROM ocombo GROUP BY category, model_ix, sample_id
  UNION ALL SELECT o.category, o.model_ix, false, 'original', o.sample_id, list_sum(p.vec) FROM oorig o
  JOIN tout_all p ON p.category = o.category AND p.pool_pos = {sql_hash_u("'0'", "o.k")} % o.n_out)
"""


def _class_ctes():
    return _OUT_CTES + "," + _ORIG_CTES + "," + _CLASS_CTES


def _vector_sum():
    return F.round(F.sum(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)), 4).alias("vsum")


@register("augment_class", sql=lambda: _sql(
    "SELECT category, CAST(model_ix AS INTEGER) AS model_ix, inside, kind, count(*) AS n, "
    "round(sum(vsum), 4) AS vsum FROM class_rows GROUP BY category, model_ix, inside, kind", _class_ctes())())
def q_augment_class(spark, d):
    """The class-wise augmented sets (M2): rows and their vectors' sum for each kind and member."""
    s = ensemble_set(spark, d)
    return s.groupBy("category", "model_ix", "inside", "kind").agg(F.count(F.lit(1)).alias("n"), _vector_sum())


@register("ensemble_training_set", sql=lambda: _sql(
    "SELECT category, CAST(m.model_ix AS INTEGER) AS model_ix, inside, count(*) AS n, round(sum(vsum), 4) AS vsum "
    f"FROM class_rows r JOIN range({N_MODELS}) m(model_ix) ON r.model_ix IN (-1, m.model_ix) "
    "GROUP BY category, m.model_ix, inside", _class_ctes())())
def q_ensemble_training_set(spark, d):
    """Each member's rows after sharing the inside ones (M3, U3), and their vectors' sum."""
    rows = AU.member_rows(ensemble_set(spark, d), N_MODELS)
    return rows.groupBy("category", "model_ix", "inside").agg(F.count(F.lit(1)).alias("n"), _vector_sum())


@register("augment_outside", sql=_sql(
    "SELECT category, model_ix, sample_id, round(sum(value), 6) AS vsum, "
    "round(sqrt(sum(value * value)), 6) AS vnorm FROM ocombo "
    "GROUP BY category, model_ix, sample_id", _OUT_CTES))
def q_augment_outside(spark, d):
    """Outside convex samples of every member (M2): each from one
    hash-chosen other category, drawn from that category's rows."""
    s = ensemble_set(spark, d).where(~F.col("inside") & (F.col("kind") == "sample"))
    return s.select("category", "model_ix", "sample_id",
                    F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("vsum"),
                    F.round(norm("vec"), 6).alias("vnorm"))


_ORIG_CTES = f"""
tout_all AS (SELECT category, vec, row_number() OVER (PARTITION BY category ORDER BY row_id) - 1
             AS pool_pos, count(*) OVER (PARTITION BY category) AS n_out FROM training WHERE NOT inside),
oorig AS (SELECT category, model_ix, sample_id, n_out, category || '|' || CAST(model_ix AS VARCHAR)
          || '|orig|' || CAST(sample_id AS VARCHAR) AS k FROM (SELECT q.category, q.model_ix, q.n_out,
          unnest(generate_series(0, q.n_in - 1)) AS sample_id FROM (SELECT t.category, m.model_ix,
          (SELECT count(*) FROM tin i WHERE i.category = t.category) AS n_in, count(*) AS n_out
          FROM training t, range({N_MODELS}) m(model_ix) WHERE NOT t.inside
          GROUP BY t.category, m.model_ix) q))
"""


_ORIG_U = sql_hash_u("'0'", "o.k")


@register("augment_originals", sql=_sql(
    "SELECT o.category, o.model_ix, o.sample_id, round(list_sum(p.vec), 6) AS vsum FROM oorig o "
    f"JOIN tout_all p ON p.category = o.category AND p.pool_pos = {_ORIG_U} % o.n_out",
    _ORIG_CTES))
def q_augment_originals(spark, d):
    """Outside originals drawn with replacement per member (M2)."""
    s = ensemble_set(spark, d).where(~F.col("inside") & (F.col("kind") == "original"))
    return s.select("category", "model_ix", "sample_id",
                    F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("vsum"))


# --- model fit / predict (rows-only checks; see tests for invariants) -------------------

def fitted_models(spark, d, params=None, n_models=N_MODELS):
    training = training_table(spark, d)
    sets = AU.ensemble_training_set(training, n_models, MULT, MULT_OUT, seed=0, spans=True)
    members = AU.member_rows(sets, n_models)
    return materialize(EN.fit_ensemble(members, params or {0: {}}, 0, training, n_models))


# member training-set sizes follow from the augmentation rule: n_in·m + n_in inside,
# n_in·m·m_out + n_in outside (SURVEY Appendix B)
_NIN = "(SELECT category, count(*) AS n_in FROM tin GROUP BY category)"
_DIM = "(SELECT max(len(vec)) FROM word_vectors)"


@register("fit_ensemble", sql=_sql(
    f"SELECT category, 0 AS param_id, model_ix, "
    f"CAST(n_in * {MULT + 1} + n_in * {MULT * MULT_OUT} + n_in AS INTEGER) AS n_rows, "
    f"CAST(n_in * {MULT + 1} AS INTEGER) AS n_inside, 256 AS n_coef, 0 AS n_comp "
    f"FROM {_NIN} c, range({N_MODELS}) m(model_ix)"))
def q_fit_ensemble(spark, d):
    m = fitted_models(spark, d)
    return m.select("category", "param_id", "model_ix", "n_rows", "n_inside",
                    F.size("coef").alias("n_coef"), "n_comp")


@register("pca_components", sql=_sql(
    f"SELECT category, model_ix, CAST({_DIM} * 0.5 AS INTEGER) AS n_comp, "
    f"CAST({_DIM} * 0.5 AS INTEGER) * {_DIM} AS n_values FROM {_NIN} c, range(2) m(model_ix)"))
def q_pca_components(spark, d):
    m = fitted_models(spark, d, {0: {"pca": 0.5}}, n_models=2)
    return m.select("category", "model_ix", "n_comp", F.size("components").alias("n_values"))


@register("training_covariance", sql=_sql(
    "SELECT category, CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(covar_pop(vec[i], vec[j]), 9) AS covariance "
    f"FROM training, range(1, {_DIM} + 1) a(i), range(1, {_DIM} + 1) b(j) WHERE i <= j GROUP BY category, i, j"))
def q_training_covariance(spark, d):
    """Covariances of a category's training vectors by merged partial sums (M5)."""
    return covariances(training_table(spark, d), ["category"]).withColumn("covariance", F.round("covariance", 9))


@register("random_fourier_features", sql=_sql(
    f"SELECT category, model_ix, 'rbf' AS kernel, 256 AS n_rff, round(1.0 / {_DIM}, 6) AS gamma "
    f"FROM {_NIN} c, range(2) m(model_ix)"))
def q_random_fourier_features(spark, d):
    m = fitted_models(spark, d, n_models=2)
    return m.select("category", "model_ix", "kernel", "n_rff", F.round("gamma", 6).alias("gamma"))


@register("fit_categories", sql=_sql(
    f"SELECT category, CAST({N_MODELS} AS BIGINT) AS n_members, "
    f"CAST({N_MODELS} * (n_in * {MULT + 1} + n_in * {MULT * MULT_OUT} + n_in) AS BIGINT) AS n_rows "
    f"FROM {_NIN} c"))
def q_fit_categories(spark, d):
    m = fitted_models(spark, d)
    return m.groupBy("category").agg(F.count(F.lit(1)).alias("n_members"),
                                     F.sum("n_rows").alias("n_rows"))


def _word_vectors(spark, d):
    return fx.word_vectors_meta(spark, d).select("word", "vec")


@register("predict_vectors_proba")
def q_predict_vectors_proba(spark, d):
    """Probability per main category for every word vector (M7)."""
    return EN.predict_proba(_word_vectors(spark, d), fitted_models(spark, d), id_cols=("word",))


@register("score_join")
def q_score_join(spark, d):
    """Member-level scores of the word vectors."""
    return EN.predict_proba(_word_vectors(spark, d), fitted_models(spark, d, n_models=2),
                            id_cols=("word",), level="member")


@register("ensemble_mean_proba")
def q_ensemble_mean_proba(spark, d):
    member = EN.predict_proba(_word_vectors(spark, d), fitted_models(spark, d),
                              id_cols=("word",), level="member")
    return EN.ensemble_mean_proba(member, ("word",))


@register("hard_vote")
def q_hard_vote(spark, d):
    votes = EN.predict_proba(_word_vectors(spark, d), fitted_models(spark, d),
                             id_cols=("word",), level="member", run_fast=True)
    return EN.hard_vote(votes, ("word",))


@register("predict_words")
def q_predict_words(spark, d):
    """Binary category flags for the benchmark words (M8: word -> vector ->
    proba -> cutoff); words without a vector get a zero vector (J3)."""
    from lexmesh.operators.vectors import lookup_vectors
    from lexmesh.plans.q_lexicon import _bench_words
    wv = _word_vectors(spark, d)
    dim = wv.agg(F.max(F.size("vec"))).first()[0]
    vecs = lookup_vectors(_bench_words(spark, d), wv, dim=dim, missing="zero")
    proba = EN.predict_proba(vecs, fitted_models(spark, d), id_cols=("word",))
    return wide_predictions(threshold_predictions(proba), MAIN, id_col="word")


@register("predict_docs")
def q_predict_docs(spark, d):
    """Document vectors (top-3 tf-idf, A5) -> proba -> cutoff -> one 0/1
    column per main category (M9)."""
    from lexmesh.operators.docvec import doc_vectors_weighted
    from lexmesh.plans.q_tfidf import fitted_tfidf
    wv = _word_vectors(spark, d)
    model, toks = fitted_tfidf(spark, d)
    dim = wv.agg(F.max(F.size("vec"))).first()[0]
    vecs = doc_vectors_weighted(model.transform(toks), wv, n_top=3, docs=fx.docs(spark, d), dim=dim)
    proba = EN.predict_proba(vecs, fitted_models(spark, d), id_cols=("doc_id",))
    return wide_predictions(threshold_predictions(proba), MAIN, id_col="doc_id")


@register("tune_params")
def q_tune_params(spark, d):
    _, ranked, best, _ = TU.tune_params(training_table(spark, d), GRID, n_iter=150, cv=5,
                                        n_best=1, n_models=2, seed=0)
    return best.select("category", "param_id", "rank", F.round("mean_score", 6).alias("mean_score"))


@register("cross_val_score")
def q_cross_val_score(spark, d):
    return TU.cross_val_score(training_table(spark, d), {}, cv=5, n_models=2, seed=0)


# --- scoring with members that SQL can restate ------------------------------------------

# A member of a category is a linear machine along the vector of one of its words: two
# parameter sets of three members each, the six first words of the category.
_LINEAR_CTES = """
members AS (SELECT l.category, l.pos // 3 AS param_id, l.pos % 3 AS model_ix, w.vec FROM category_lexicon l
            JOIN word_vectors w ON w.word = l.term WHERE l.category IN ('c0', 'c1') AND l.pos < 6),
scores AS (SELECT w.word, m.category, m.param_id, m.model_ix, list_inner_product(w.vec, m.vec) AS f,
           1.0 / (1.0 + exp(-4.0 * list_inner_product(w.vec, m.vec))) AS proba FROM word_vectors w, members m)
"""


def linear_members(spark, d):
    """Members with given coefficients, as fitting would return them."""
    wv = fx.word_vectors_meta(spark, d)
    rows = fx.main_lexicon(spark, d, wv).where("pos < 6").join(wv, F.col("term") == F.col("word"))
    dim, none = F.size("vec"), F.array().cast("array<double>")
    members = rows.select(
        "category", F.floor(F.col("pos") / 3).cast("int").alias("param_id"), F.lit(-1).alias("fold"),
        (F.col("pos") % 3).cast("int").alias("model_ix"), F.lit("linear").alias("kernel"),
        F.array_repeat(F.lit(0.0), dim).alias("mean"), F.array_repeat(F.lit(1.0), dim).alias("scale"),
        none.alias("components"), F.lit(0).alias("n_comp"), F.lit(0).cast("bigint").alias("rff_seed"),
        F.lit(1.0).alias("gamma"), F.lit(0).alias("n_rff"), F.col("vec").alias("coef"), F.lit(0.0).alias("intercept"),
        F.lit(-4.0).alias("platt_a"), F.lit(0.0).alias("platt_b"), F.lit(0).alias("n_rows"), F.lit(0).alias("n_inside"),
        F.lit("fourier").alias("solver"), none.alias("support"), F.lit(0.0).alias("gap"))
    return materialize(members, "members")


@register("linear_member_scores", sql=with_fixtures(
    "SELECT word, category, CAST(param_id AS INTEGER) AS param_id, CAST(model_ix AS INTEGER) AS model_ix, "
    "round(proba, 6) AS proba FROM scores", _LINEAR_CTES))
def q_linear_member_scores(spark, d):
    """Every member's probability of every word vector."""
    out = EN.predict_proba(_word_vectors(spark, d), linear_members(spark, d), id_cols=("word",), level="member")
    return out.select("word", "category", "param_id", "model_ix", F.round("proba", 6).alias("proba"))


@register("linear_mean_proba", sql=with_fixtures(
    "SELECT word, category, round(avg(p), 6) AS proba FROM (SELECT word, category, param_id, avg(proba) AS p "
    "FROM scores GROUP BY word, category, param_id) GROUP BY word, category", _LINEAR_CTES))
def q_linear_mean_proba(spark, d):
    """Mean over members, then over parameter sets."""
    out = EN.predict_proba(_word_vectors(spark, d), linear_members(spark, d), id_cols=("word",))
    return out.select("word", "category", F.round("proba", 6).alias("proba"))


@register("linear_hard_vote", sql=with_fixtures(
    "SELECT word, category, round(avg(v), 6) AS share FROM (SELECT word, category, param_id, "
    "avg(CAST(f > 0 AS INTEGER)) AS v FROM scores GROUP BY word, category, param_id) GROUP BY word, category",
    _LINEAR_CTES))
def q_linear_hard_vote(spark, d):
    """Share of members that vote for the category."""
    votes = EN.predict_proba(_word_vectors(spark, d), linear_members(spark, d), id_cols=("word",), level="member",
                             run_fast=True)
    return EN.hard_vote(votes, ("word",)).select("word", "category", F.round("proba", 6).alias("share"))


@register("linear_predict_words", sql=with_fixtures(
    "SELECT b.word, CAST(coalesce(max(p.proba) FILTER (p.category = 'c0'), 0.5) >= 0.5 AS INTEGER) AS c0, "
    "CAST(coalesce(max(p.proba) FILTER (p.category = 'c1'), 0.5) >= 0.5 AS INTEGER) AS c1 FROM bench_words b "
    "LEFT JOIN (SELECT word, category, avg(pp) AS proba FROM (SELECT word, category, param_id, avg(proba) AS pp "
    "FROM scores GROUP BY word, category, param_id) GROUP BY word, category) p ON p.word = b.word GROUP BY b.word",
    SQL_BENCH_WORDS.strip().rstrip(",") + "," + _LINEAR_CTES))
def q_linear_predict_words(spark, d):
    """Flags of the benchmark words through the fitted classifier's own method (M8, P12);
    a word without a vector has a zero one, which every member gives 0.5."""
    from lexmesh.operators.classifier import ClassifierModel
    from lexmesh.plans.q_lexicon import _bench_words
    wv = _word_vectors(spark, d)
    dim = wv.agg(F.max(F.size("vec"))).first()[0]
    model = ClassifierModel(linear_members(spark, d), MAIN, None, wv, dim)
    return model.predict_words(_bench_words(spark, d)).select("word", "c0", "c1")


# --- scoring operators checked against labels (O) --------------------------------------

_CUTOFFS = [-1.0, -0.5, 0.0, 0.5, 1.0]
_LABEL_CTES = """
ws_tokens AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0b]+')) AS word FROM documents),
tok_scores AS (SELECT t.doc_id, wp.pol FROM ws_tokens t JOIN word_pol wp ON wp.word = t.word),
raw AS (SELECT d.doc_id, avg(ts.pol) AS s FROM documents d
        LEFT JOIN tok_scores ts ON ts.doc_id = d.doc_id GROUP BY d.doc_id),
stats AS (SELECT avg(s) AS m, stddev_pop(s) AS sd FROM raw WHERE s IS NOT NULL),
scaled AS (SELECT doc_id, (s - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS polarity FROM raw, stats),
lab AS (SELECT l.doc_id, l.quality, l.toxic, s.polarity FROM labels l JOIN scaled s ON s.doc_id = l.doc_id),
cut AS (SELECT unnest(range(0, 5)) AS param_id, unnest([-1.0, -0.5, 0.0, 0.5, 1.0]) AS cutoff),
folds AS (SELECT *, """ + sql_hash_u("doc_id", "'fold'") + """ % 3 AS fold FROM lab),
fold_pred AS (SELECT c.param_id, f.fold, f.quality AS label, coalesce(f.polarity > c.cutoff, false) AS pred
              FROM folds f, cut c),
cvres AS (SELECT param_id, fold, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS score
          FROM (SELECT param_id, fold, sum(CAST(label = 1 AND pred AS INTEGER)) AS tp,
                sum(CAST(label = 0 AND pred AS INTEGER)) AS fp, sum(CAST(label = 1 AND NOT pred AS INTEGER)) AS fn
                FROM fold_pred GROUP BY param_id, fold)),
cvmean AS (SELECT param_id, round(avg(score), 12) AS mean_score FROM cvres GROUP BY param_id),
cvrank AS (SELECT param_id, mean_score, rank() OVER (ORDER BY mean_score DESC NULLS LAST) - 1 AS rank FROM cvmean)
"""


def _labelled(spark, d):
    from lexmesh.plans.q_scaling import fit_doc_scaling
    _, scaled = fit_doc_scaling(spark, d)
    lab = fx.table(spark, d, "labels")
    return lab.join(scaled, "doc_id")


def _cv_scores(spark, d):
    lab = _labelled(spark, d).withColumn("fold", (hash_u("doc_id", F.lit("fold")) % 3).cast("int"))
    # each labelled document is scored under every candidate cutoff (a
    # parameter list, expanded in place: no join)
    pred = lab.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("param_id"),
                                                         F.lit(c).alias("cutoff"))
                                                for i, c in enumerate(_CUTOFFS)])).alias("p"))
    pred = pred.select("fold", F.col("p.param_id").alias("param_id"),
                       F.col("quality").alias("label"),
                       F.coalesce(F.col("polarity") > F.col("p.cutoff"), F.lit(False))
                       .alias("prediction"))
    return TU.f1_score(pred, "label", "prediction", ("param_id", "fold"))


def _lsql(body):
    return with_fixtures(body, _LABEL_CTES)


@register("f1_score", sql=_lsql(
    "SELECT label_name, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / "
    "(2 * tp + fp + fn) END, 6) AS score FROM (SELECT label_name, "
    "sum(CAST(y = 1 AND p AS INTEGER)) AS tp, sum(CAST(y = 0 AND p AS INTEGER)) AS fp, "
    "sum(CAST(y = 1 AND NOT p AS INTEGER)) AS fn FROM (SELECT unnest(['quality', 'toxic']) AS label_name, "
    "unnest([quality, toxic]) AS y, coalesce(1.0 / (1.0 + exp(-polarity)) > 0.5, false) AS p FROM lab) "
    "GROUP BY label_name)"))
def q_f1_score(spark, d):
    """F1 of ``proba > 0.5`` (logistic scaled polarity) against each label."""
    lab = _labelled(spark, d)
    p = F.coalesce((1.0 / (1.0 + F.exp(-F.col("polarity")))) > 0.5, F.lit(False))
    long = lab.select(F.explode(F.array(
        F.struct(F.lit("quality").alias("label_name"), F.col("quality").alias("y")),
        F.struct(F.lit("toxic").alias("label_name"), F.col("toxic").alias("y")))).alias("e"),
        p.alias("prediction"))
    long = long.select("e.label_name", F.col("e.y").alias("label"), "prediction")
    out = TU.f1_score(long, "label", "prediction", ("label_name",))
    return out.select("label_name", F.round("score", 6).alias("score"))


@register("custom_score", sql=_lsql(
    "SELECT round(avg(CAST(coalesce(polarity > 0, false) = (quality = 1) AS DOUBLE)), 6) "
    "AS score FROM lab"))
def q_custom_score(spark, d):
    """A caller-supplied score (X2): accuracy of ``polarity > 0`` for quality."""
    lab = _labelled(spark, d).select(
        F.col("quality").alias("label"),
        F.coalesce(F.col("polarity") > 0, F.lit(False)).alias("prediction"))
    acc = F.avg((F.col("prediction") == (F.col("label") == 1)).cast("double"))
    return TU.custom_score(lab, acc).select(F.round("score", 6).alias("score"))


@register("cv_mean_nonmissing", sql=_lsql(
    "SELECT param_id, round(mean_score, 6) AS mean_score FROM cvmean"))
def q_cv_mean_nonmissing(spark, d):
    """Cutoff search by 3-fold CV on the labelled documents."""
    out = TU.cv_mean_nonmissing(_cv_scores(spark, d), ("param_id",))
    return out.select("param_id", F.round("mean_score", 6).alias("mean_score"))


@register("score_ranks", sql=_lsql("SELECT param_id, rank FROM cvrank"))
def q_score_ranks(spark, d):
    means = TU.cv_mean_nonmissing(_cv_scores(spark, d), ("param_id",))
    return TU.score_ranks(means.withColumn("mean_score", F.round("mean_score", 12))) \
             .select("param_id", "rank")


@register("best_params", sql=_lsql(
    "SELECT param_id, rank FROM (SELECT param_id, rank, row_number() OVER (ORDER BY rank, param_id) "
    "AS rn FROM cvrank WHERE rank < 2) WHERE rn <= 2"))
def q_best_params(spark, d):
    means = TU.cv_mean_nonmissing(_cv_scores(spark, d), ("param_id",))
    ranked = TU.score_ranks(means.withColumn("mean_score", F.round("mean_score", 12)))
    return TU.best_params(ranked, 2).select("param_id", "rank")
