"""The fitted document processor (M15): cleaner, analyzer, tf-idf vocabulary
and, if asked for, word clusters; it turns documents into vectors.

Pipeline of both methods: cleaning rules (F2) -> tokens -> annotation, filters,
normalisation, stopwords (P7-P9, J6) -> tf-idf (A3, A4) -> one vector for each
document, from its top words (A5) or its top clusters (C3, C4).  Documents
without a known word get a zero vector.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmesh.functions.rules import DEFAULT_RULES
from lexmesh.operators import clusters as C
from lexmesh.operators.counts import counts_in_place, n_buckets, surface_counts, text_buckets
from lexmesh.operators.docvec import doc_vectors_weighted
from lexmesh.operators.tfidf import TfidfModel, fit_surfaces, weighted
from lexmesh.operators.tokens import analyzed_term_frequency, clean_docs, prepare_annotations
from lexmesh.operators.util import in_place_join, text_parts
from lexmesh.session import discard, materialize

SETTINGS = {"method": "tfidf", "min_df": 5, "max_df": 0.95, "n_top_words": 3, "n_words": 40000,
            "distance_threshold": 0.5, "n_top_clusters": 3, "cluster_share": None, "clean": True}


@dataclass
class DocumentProcessor:
    """Fitted state: vocabulary, vectors and clusters as tables, settings as a dict."""
    tfidf: TfidfModel
    word_vectors: DataFrame
    annotations: DataFrame
    stopwords: DataFrame
    dim: int
    settings: dict
    clusters: DataFrame | None = None
    words: DataFrame | None = None
    forest: DataFrame | None = None
    known: DataFrame | None = None

    def counts(self, docs: DataFrame) -> DataFrame:
        return _counts(docs, self.annotations, self.stopwords, self.settings["clean"])

    def weights(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, word, tf, weight)`` of the fitted vocabulary."""
        if self.known is None:
            # surfaces of vocabulary words: but for those of rare ones, counts stay with their documents
            mapping = prepare_annotations(self.annotations, self.stopwords).withColumnRenamed("word", "norm")
            idf = self.tfidf.vocab.select(F.col("word").alias("norm"), "idf", "df")
            self.known = materialize(mapping.join(idf, "norm").withColumnRenamed("surface", "word"), "known")
        docs = docs.select("doc_id", "text")
        found = counts_in_place(clean_docs(docs, DEFAULT_RULES) if self.settings["clean"] else docs)
        joined = in_place_join(found, self.known, "word", "df", buckets=n_buckets(docs)).drop("word")
        tf = joined.groupBy("doc_id", F.col("norm").alias("word")).agg(
            F.sum("n").alias("tf"), F.first("idf").alias("idf"))
        return weighted(tf)

    def doc_clusters(self, docs: DataFrame) -> DataFrame:
        s = self.settings
        # read once, by the join that doc_clusters writes
        return C.doc_clusters(self.weights(docs), self.clusters, self.word_vectors, s["n_top_clusters"], s["cluster_share"])

    def recut(self, distance_threshold: float) -> "DocumentProcessor":
        """The processor with other clusters, from the fitted dendrogram: any
        threshold up to the fitted one."""
        if self.forest is None:
            raise ValueError("fitted without clusters")
        if distance_threshold > self.settings["distance_threshold"]:
            raise ValueError("the dendrogram ends at the fitted threshold")
        clusters = C.cut_forest(self.words, self.forest, distance_threshold)
        # the fitted threshold stays the dendrogram's end
        return replace(self, clusters=clusters)

    def vectors(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, vec)``, a row for each document."""
        if self.settings["method"] == "clusters":
            return C.doc_vectors_clusters(self.doc_clusters(docs), docs=docs, dim=self.dim)
        return doc_vectors_weighted(self.weights(docs), self.word_vectors, n_top=self.settings["n_top_words"],
                                    docs=docs, dim=self.dim)

    def polarity(self, docs: DataFrame, axis) -> DataFrame:
        """Unscaled polarity of each document (A12 or the tf-idf path); without
        a known word it is 0 with clusters and the zero vector's 0 with words."""
        from lexmesh.operators.scaling import doc_polarity_clusters, doc_polarity_vectors
        if self.settings["method"] == "clusters":
            found = doc_polarity_clusters(self.doc_clusters(docs), axis)
            return docs.select("doc_id").join(found, "doc_id", "left") \
                .withColumn("polarity", F.coalesce("polarity", F.lit(0.0)))
        return doc_polarity_vectors(self.vectors(docs), axis)

    def tables(self) -> dict[str, DataFrame]:
        out = {"vocab": self.tfidf.vocab, "pruned": self.tfidf.pruned, "word_vectors": self.word_vectors,
               "annotations": self.annotations, "stopwords": self.stopwords}
        if self.clusters is not None:
            out |= {"clusters": self.clusters, "cluster_words": self.words, "forest": self.forest}
        return out

    def params(self) -> dict:
        return {"settings": self.settings, "dim": self.dim, "n_docs": self.tfidf.n_docs}


def _counts(docs: DataFrame, annotations: DataFrame, stopwords: DataFrame, clean: bool) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return analyzed_term_frequency(clean_docs(docs, DEFAULT_RULES) if clean else docs, annotations, stopwords)


def fit_processor(docs: DataFrame, word_vectors: DataFrame, annotations: DataFrame, stopwords: DataFrame,
                  keep_words: DataFrame | None = None, **settings) -> DocumentProcessor:
    """Fit on a corpus.  ``keep_words(word)`` (lexicon terms) keep their vectors
    beside the vocabulary's (U2, J2)."""
    unknown = set(settings) - set(SETTINGS)
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    s = SETTINGS | settings
    if s["method"] not in ("tfidf", "clusters"):
        raise ValueError(f"unknown method {s['method']!r}")
    parts = text_parts(docs)
    buckets = text_buckets(docs, parts or 1)
    surfaces = surface_counts(docs, DEFAULT_RULES if s["clean"] else None, buckets, parts)
    model = fit_surfaces(surfaces, prepare_annotations(annotations, stopwords), docs, s["min_df"], s["max_df"], buckets=buckets)
    discard(surfaces)  # what the model needs of them is written
    keep = model.vocab.select("word")
    if keep_words is not None:
        keep = keep.union(keep_words.select("word")).distinct()
    vectors = materialize(word_vectors.select("word", "vec").join(keep, "word", "left_semi"), "vectors")
    dim = vectors.agg(F.max(F.size("vec"))).first()[0] or 0
    clusters = words = forest = None
    if s["method"] == "clusters":
        words = materialize(C.vocab_top_n_words(model.vocab, vectors, s["n_words"]), "words")
        forest = C.similarity_forest(words, vectors, s["distance_threshold"])
        clusters = C.cut_forest(words, forest, s["distance_threshold"])
    return DocumentProcessor(model, vectors, annotations, stopwords, dim, s, clusters, words, forest)


def load_processor(spark: SparkSession, tables: dict[str, DataFrame], params: dict) -> DocumentProcessor:
    s = params["settings"]
    model = TfidfModel(tables["vocab"], params["n_docs"], s["min_df"], s["max_df"], tables["pruned"])
    return DocumentProcessor(model, tables["word_vectors"], tables["annotations"], tables["stopwords"],
                             params["dim"], s, tables.get("clusters"), tables.get("cluster_words"),
                             tables.get("forest"))
