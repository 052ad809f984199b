"""Registered queries: tokens, tf-idf, document vectors
(P7-P10, J6, J7, A1-A5, A18, A19, N1, N5, U2, U5, F4, F7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmesh.functions.vectors import cosine, norm
from lexmesh.operators import docvec as D
from lexmesh.operators import tfidf as TF
from lexmesh.operators import tokens as TK
from lexmesh.operators.util import sent_if_small
from lexmesh.plans import fixtures as fx
from lexmesh.plans.fixtures import with_fixtures as W
from lexmesh.plans.registry import register

WS = r"'[ \t\n\r\f\x0b]+'"


def _annotated(spark, d):
    """Counted surface forms with their annotations: one row per document and form."""
    return TK.annotate_tokens(fx.surface_counts(spark, d), fx.annotations(spark, d))


def fitted_tfidf(spark, d):
    """(model, term counts) fitted on the whole corpus; the counts are
    written once, bucketed by document, and feed both fit and transform."""
    tf = fx.analyzed_tf(spark, d)
    model = TF.fit_tfidf(tf, fx.table(spark, d, "documents"), min_df=5, max_df=0.95, counted=True)
    return _CountedModel(model, fx.tf_buckets(spark, d)), tf


class _CountedModel:
    """The fitted model, transforming the pre-counted table."""

    def __init__(self, model, buckets):
        self._m, self._buckets = model, buckets
        self.vocab, self.n_docs, self.pruned = model.vocab, model.n_docs, model.pruned
        self.min_df, self.max_df = model.min_df, model.max_df

    def transform(self, tf, **kw):
        return self._m.transform(tf, counted=True, buckets=self._buckets, **kw)


@register("annotate_tokens", sql=W(
    "SELECT doc_id, upos, coalesce(ent_type, '-') AS ent_type, count(*) AS n_tokens, "
    "count(DISTINCT lemma) AS n_lemmas FROM annotated GROUP BY doc_id, upos, ent_type"))
def q_annotate_tokens(spark, d):
    ann = _annotated(spark, d)
    return ann.groupBy("doc_id", "upos", F.coalesce("ent_type", F.lit("-")).alias("ent_type")) \
              .agg(F.sum("n").alias("n_tokens"), F.countDistinct("lemma").alias("n_lemmas"))


@register("filter_tokens", sql=W("SELECT doc_id, count(*) AS n_kept FROM filtered GROUP BY doc_id"))
def q_filter_tokens(spark, d):
    kept = TK.filter_tokens(_annotated(spark, d))
    return kept.groupBy("doc_id").agg(F.sum("n").alias("n_kept"))


@register("normalize_tokens", sql=W(
    "SELECT word, count(*) AS n FROM normalized_ok GROUP BY word"))
def q_normalize_tokens(spark, d):
    norm_toks = TK.normalize_tokens(TK.filter_tokens(_annotated(spark, d)))
    return norm_toks.groupBy("word").agg(F.sum("n").alias("n"))


@register("stopword_list", sql=W(
    "SELECT word, count(*) AS n FROM normalized_ok WHERE word IN (SELECT word FROM stopwords) "
    "GROUP BY word"))
def q_stopword_list(spark, d):
    """Stopwords of the list that occur in the corpus, with their counts."""
    norm_toks = TK.normalize_tokens(TK.filter_tokens(_annotated(spark, d)))
    sw = TK.stopword_list(spark)
    return norm_toks.groupBy("word").agg(F.sum("n").alias("n")).join(sw, "word", "left_semi")


@register("anti_stopwords", sql=W(
    "SELECT doc_id, count(*) AS n_kept FROM letter_tokens "
    "WHERE word NOT IN (SELECT word FROM stopwords) GROUP BY doc_id"))
def q_anti_stopwords(spark, d):
    kept = TK.anti_stopwords(TK.count_tokens(fx.letter_tokens(spark, d)), TK.stopword_list(spark))
    return kept.groupBy("doc_id").agg(F.sum("n").alias("n_kept"))


@register("tokens_in_vocabulary", sql=W(
    "SELECT doc_id, count(*) AS n_in_vocab FROM (SELECT doc_id, "
    f"unnest(regexp_split_to_array(text, {WS})) AS word FROM documents) t "
    "WHERE word IN (SELECT word FROM word_vectors) GROUP BY doc_id"))
def q_tokens_in_vocabulary(spark, d):
    wv = fx.word_vectors_meta(spark, d)
    toks = TK.count_tokens(TK.tokenize(fx.docs(spark, d), mode="whitespace"))
    return TK.tokens_in_vocabulary(toks, wv).groupBy("doc_id").agg(F.sum("n").alias("n_in_vocab"))


@register("term_frequency", sql=W("SELECT doc_id, word, tf FROM tf"))
def q_term_frequency(spark, d):
    """A1 over the token-level analyzer output (the pre-counted path used
    by the fitted processor gives the same table)."""
    return TF.term_frequency(fx.analyzed_tokens(spark, d))


@register("document_frequency", sql=W("SELECT word, df FROM vocab"))
def q_document_frequency(spark, d):
    model, _ = fitted_tfidf(spark, d)
    return model.vocab.select("word", "df")


@register("fit_tfidf", sql=W("SELECT word, df, round(idf, 6) AS idf FROM vocab"))
def q_fit_tfidf(spark, d):
    model, _ = fitted_tfidf(spark, d)
    return model.vocab.select("word", "df", F.round("idf", 6).alias("idf"))


@register("tfidf_transform", sql=W(
    "SELECT doc_id, word, tf, round(weight, 6) AS weight FROM tfidf"))
def q_tfidf_transform(spark, d):
    model, toks = fitted_tfidf(spark, d)
    out = model.transform(toks)
    return out.select("doc_id", "word", "tf", F.round("weight", 6).alias("weight"))


@register("vocab_index", sql=W(
    "SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx FROM vocab"))
def q_vocab_index(spark, d):
    model, _ = fitted_tfidf(spark, d)
    return TF.vocab_index(model.vocab).select("word", "idx")


@register("document_terms", sql=W(
    "SELECT doc_id, array_to_string(list_sort(list(word)), ' ') AS terms FROM tfidf "
    "WHERE weight <> 0 GROUP BY doc_id"))
def q_document_terms(spark, d):
    model, toks = fitted_tfidf(spark, d)
    out = TF.document_terms(model.transform(toks))
    return out.select("doc_id", F.array_join("terms", " ").alias("terms"))


@register("keep_vocabulary", sql=W(
    "SELECT term AS word FROM category_lexicon UNION SELECT word FROM vocab"))
def q_keep_vocabulary(spark, d):
    model, _ = fitted_tfidf(spark, d)
    lex = fx.category_lexicon(spark, d, wv=fx.word_vectors_meta(spark, d))
    return TF.keep_vocabulary(lex, model.vocab)


@register("effective_stop_words", sql=W(
    "SELECT word FROM stopwords UNION SELECT word FROM dfs, n_docs WHERE df < 5 OR df > 0.95 * n"))
def q_effective_stop_words(spark, d):
    model, _ = fitted_tfidf(spark, d)
    return TF.effective_stop_words(TK.stopword_list(spark), model)


@register("full_vocabulary_count", sql=W(
    "SELECT count(*) AS n_words FROM (SELECT term AS word FROM main_lexicon UNION "
    "SELECT word FROM vocab UNION SELECT term FROM support_lexicon)"))
def q_full_vocabulary_count(spark, d):
    model, _ = fitted_tfidf(spark, d)
    wvm = fx.word_vectors_meta(spark, d)
    return TF.full_vocabulary_count(fx.main_lexicon(spark, d, wvm), model.vocab,
                                    fx.support_lexicon(spark, d, wvm))


def _tfidf_rows(spark, d):
    model, toks = fitted_tfidf(spark, d)
    return model.transform(toks)


@register("top_words_per_doc", sql=W(
    "SELECT doc_id, rnk AS rank, word, round(norm_weight, 6) AS norm_weight FROM top3"))
def q_top_words_per_doc(spark, d):
    wv = fx.word_vectors_meta(spark, d)
    cand = _tfidf_rows(spark, d).join(sent_if_small(wv.select("word")), "word", "left_semi")
    top = D.top_words_per_doc(cand, 3)
    return top.select("doc_id", "rank", "word", F.round("norm_weight", 6).alias("norm_weight"))


def _doc_vectors(spark, d, method):
    wv = fx.word_vectors_meta(spark, d).select("word", "vec")
    dim = wv.agg(F.max(F.size("vec"))).first()[0]
    return D.doc_vectors_weighted(_tfidf_rows(spark, d), wv, n_top=3, docs=fx.docs(spark, d),
                                  dim=dim, method=method)


@register("doc_vectors_weighted", sql=W("SELECT doc_id, pos, round(value, 6) AS value FROM docvec"))
def q_doc_vectors_weighted(spark, d):
    return D.explode_vectors(_doc_vectors(spark, d, "summarizer"))


@register("linear_combination", sql=W("SELECT doc_id, pos, round(value, 6) AS value FROM docvec"))
def q_linear_combination(spark, d):
    return D.explode_vectors(_doc_vectors(spark, d, "array"))


@register("cosine_similarity", sql=W(
    "SELECT t.doc_id, t.word, round(CASE WHEN dn = 0 OR wn = 0 THEN 0 ELSE dp / (dn * wn) END, 6) "
    "AS cosine FROM top3 t JOIN (SELECT e.doc_id, w.word, sum(e.value * w.x) AS dp FROM docvec e "
    "JOIN (SELECT word, unnest(vec) AS x, unnest(generate_series(0, len(vec) - 1)) AS i "
    "FROM word_vectors) w ON w.i = e.pos GROUP BY e.doc_id, w.word) p "
    "ON p.doc_id = t.doc_id AND p.word = t.word "
    "JOIN (SELECT doc_id, sqrt(sum(value * value)) AS dn FROM docvec GROUP BY doc_id) n "
    "ON n.doc_id = t.doc_id JOIN (SELECT word, sqrt(list_sum(list_transform(vec, "
    "lambda x: x * x))) AS wn FROM word_vectors) m ON m.word = t.word"))
def q_cosine_similarity(spark, d):
    """Cosine between each document vector and the vectors of its top words."""
    wv = fx.word_vectors_meta(spark, d).select("word", "vec")
    vecs = _doc_vectors(spark, d, "summarizer").withColumnRenamed("vec", "dvec")
    cand = _tfidf_rows(spark, d).join(sent_if_small(wv.select("word")), "word", "left_semi")
    top = D.top_words_per_doc(cand, 3).select("doc_id", "word")
    pairs = top.join(vecs, "doc_id").join(wv, "word")
    return pairs.select("doc_id", "word", F.round(cosine("dvec", "vec"), 6).alias("cosine"))
