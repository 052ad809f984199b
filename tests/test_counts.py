"""Bucketed counts: equal to the plain path, and read back without an exchange per document."""

import re

import pytest
from pyspark.sql import functions as F

from lexmesh.operators import counts as CN
from lexmesh.operators import docvec as D
from lexmesh.operators import tfidf as TF
from lexmesh.operators import tokens as TK

DOCS = [(1, "Haus Garten Haus, CDU", "x"), (2, "Garten Auto Haus", "x"), (3, "", None), (4, None, ""),
        (5, "Auto " * 400 + "Baum", "y"), (6, "12 -- ..", "")] + [(10 + i, "Haus Baum Weg " * (i % 4), "z") for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, word string")


@pytest.fixture(scope="module")
def tables(spark, docs):
    surfaces = CN.surface_counts(docs)
    annotations = TK.derive_annotations(CN.distinct_surfaces(surfaces))
    return surfaces, annotations, TK.stopword_list(spark)


def test_counts_equal_the_plain_path(docs, tables):
    surfaces, annotations, stopwords = tables
    plain = TK.count_tokens(TK.tokenize(TK.clean_docs(docs), lower=False))
    assert sorted(surfaces.collect()) == sorted(plain.collect())
    got = CN.term_counts(surfaces, annotations, stopwords)
    want = TK.analyzed_term_frequency(TK.clean_docs(docs), annotations, stopwords)
    assert sorted(got.collect()) == sorted(want.collect())
    assert {r.doc_id for r in got.collect()} <= {1, 2, 5, *range(10, 50)}


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if re.search(r"\bExchange hashpartitioning\(doc_id", line)]


def test_no_exchange_on_the_document_after_the_scan(docs, tables):
    surfaces, annotations, stopwords = tables
    tf = CN.term_counts(surfaces, annotations, stopwords)
    model = TF.fit_tfidf(tf, docs, min_df=1, max_df=1.0, counted=True)
    weights = model.transform(tf, counted=True)
    top = D.top_words_per_doc(weights, 2)
    terms = TF.document_terms(weights)
    norms = tf.groupBy("doc_id").agg(F.sum("tf").alias("n"))
    for df in (weights, top, terms, norms):
        assert exchanges(df) == []
    # the same steps on the plain counts do need one
    assert exchanges(D.top_words_per_doc(TF.tfidf_transform(TK.analyzed_term_frequency(
        docs, annotations, stopwords), model.vocab, counted=True), 2))


def test_one_file_for_each_bucket(spark, docs):
    table = CN.write_bucketed(CN.by_key(docs.select("doc_id", "text"), buckets=5), "docs", buckets=5)
    assert sorted(r.doc_id for r in table.collect()) == sorted(r[0] for r in DOCS)
    assert len(table.inputFiles()) <= 5


def test_empty_corpus(spark, docs):
    surfaces = CN.surface_counts(docs.where("doc_id < 0"))
    annotations = TK.derive_annotations(CN.distinct_surfaces(surfaces))
    assert CN.term_counts(surfaces, annotations, TK.stopword_list(spark)).collect() == []


def test_cleaned_texts_move_once(docs):
    plan = CN.counts_in_place(TK.clean_docs(docs))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and plan.count("Exchange hashpartitioning(doc_id") == 1
    assert "Exchange hashpartitioning(doc_id#" in plan and ", word#" not in \
        "".join(x for x in plan.splitlines() if "Exchange" in x)


@pytest.mark.parametrize("min_df, max_df", [(1, 1.0), (2, 0.6), (5, 0.95), (0.1, 30), (10, 1.0)])
def test_vocabulary_from_surfaces_equals_that_from_counts(spark, docs, tables, min_df, max_df):
    surfaces, _, stopwords = tables
    # two surfaces of one word, also in one document; one surface of two words
    annotations = spark.createDataFrame(
        [("Haus", "Haus", "NOUN", None), ("Garten", "Haus", "NOUN", None), ("Auto", "auto", "VERB", None),
         ("Weg", "weg", "ADV", None), ("Weg", "pfad", "NOUN", None), ("Baum", "Baum", "OTHER", None),
         ("CDU", "cdu", "NOUN", "PER"), ("fehlt", "nie", "ADJ", None)], "surface string, lemma string, upos string, ent_type string")
    want = TF.fit_tfidf(CN.term_counts(surfaces, annotations, stopwords), docs, min_df, max_df, counted=True)
    got = TF.fit_surfaces(surfaces, TK.prepare_annotations(annotations, stopwords), docs, min_df, max_df)
    assert sorted(got.vocab.collect()) == sorted(want.vocab.collect())
    assert sorted(got.pruned.collect()) == sorted(want.pruned.collect()) and got.n_docs == want.n_docs


def test_weights_of_the_processor_stay_with_their_documents(spark, docs, tables):
    from lexmesh.operators.processor import fit_processor
    surfaces, annotations, stopwords = tables
    wv = spark.createDataFrame([(w, [1.0, float(k)]) for k, w in enumerate(["Haus", "haus", "baum", "Auto", "auto", "weg", "Weg"])],
                               "word string, vec array<double>")
    more = docs.unionByName(docs.limit(3))  # repeated ids
    p = fit_processor(more, wv, annotations, stopwords, min_df=1, max_df=1.0)
    got = p.weights(more)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the texts
    want = p.tfidf.transform(p.counts(more), counted=True)
    rows = lambda df: sorted((r.doc_id, r.word, r.tf, round(r.weight, 12)) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) > 40


def test_buckets_grow_with_the_text(spark, docs, monkeypatch):
    """A bucket, which one task counts and sorts, had a share of the corpus that grew with it."""
    from lexmesh.operators import util
    least = CN.n_buckets(docs)
    assert CN.text_buckets(docs) == least
    monkeypatch.setattr(util, "TASK_TEXT", 100)
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    n = CN.text_buckets(docs)
    assert n % least == 0 and held / 100 <= n < held / 100 + least
    surfaces = CN.surface_counts(docs)
    assert surfaces.groupBy("doc_id").count().rdd.getNumPartitions() == n
    monkeypatch.undo()
    want = CN.surface_counts(docs)
    assert sorted(map(tuple, surfaces.collect())) == sorted(map(tuple, want.collect()))
