"""tf-idf as long tables.

The sparse docs x vocabulary matrix *is* the long table
``tfidf(doc_id, word, tf, weight)``.  Shuffles: one on ``(doc_id, word)``
for term counts (map-side partial counts first) and one on ``word`` for
document frequencies (again partial counts per map task, so a hot word
costs one row per task, not one per occurrence).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.operators.util import global_row_number, in_place_join, sent_if_small
from lexmesh.session import materialize


def term_frequency(tokens: DataFrame, id_col: str = "doc_id", col: str = "word") -> DataFrame:
    """Raw count per (document, term) (A1)."""
    return tokens.groupBy(id_col, col).agg(F.count(F.lit(1)).alias("tf"))


def df_bounds(min_df, max_df, n_docs_col) :
    """Inclusive document-frequency limits: int = count, float = share of n."""
    lo = F.lit(min_df) if isinstance(min_df, int) else F.lit(float(min_df)) * n_docs_col
    hi = F.lit(max_df) if isinstance(max_df, int) else F.lit(float(max_df)) * n_docs_col
    return lo, hi


def document_frequency(tf: DataFrame, col: str = "word") -> DataFrame:
    """Documents per term (A2, before pruning)."""
    return tf.groupBy(col).agg(F.count(F.lit(1)).alias("df"))


@dataclass
class TfidfModel:
    """Fitted tf-idf state: ``vocab(word, df, idf)`` and the corpus size."""
    vocab: DataFrame
    n_docs: int
    min_df: object
    max_df: object
    pruned: DataFrame  # words removed by the df limits

    def transform(self, tokens: DataFrame, id_col: str = "doc_id", col: str = "word",
                  normalize: bool = True, counted: bool = False, buckets: int | None = None) -> DataFrame:
        return tfidf_transform(tokens, self.vocab, id_col=id_col, col=col, normalize=normalize,
                               counted=counted, buckets=buckets)


def fit_tfidf(tokens: DataFrame, docs: DataFrame, min_df=5, max_df=0.95,
              id_col: str = "doc_id", col: str = "word", counted: bool = False) -> TfidfModel:
    """Vocabulary with sklearn-default smooth idf (A3):
    ``idf = ln((1 + n) / (1 + df)) + 1``, keeping ``lo <= df <= hi``.
    ``n`` counts every document, also those without a surviving token.
    ``counted=True``: ``tokens`` already is a term-frequency table."""
    n_docs = docs.select(id_col).count()
    n = F.lit(n_docs).cast("double")
    tf = tokens if counted else term_frequency(tokens, id_col, col)
    dfs = document_frequency(tf, col)
    lo, hi = df_bounds(min_df, max_df, n)
    keep = (F.col("df") >= lo) & (F.col("df") <= hi)
    # written once: the vocabulary is reused by transform, pruning and indexing
    dfs = materialize(dfs)
    vocab = (dfs.where(keep)
                .withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0))
    pruned = dfs.where(~keep).select(col)
    return TfidfModel(vocab=vocab, n_docs=n_docs, min_df=min_df, max_df=max_df, pruned=pruned)


def fit_surfaces(surfaces: DataFrame, mapping: DataFrame, docs: DataFrame, min_df=5, max_df=0.95,
                 id_col: str = "doc_id", col: str = "word", buckets: int | None = None) -> TfidfModel:
    """:func:`fit_tfidf` of the words that ``mapping(surface, word)`` gives the surface
    counts ``surfaces(doc_id, word, n)``, a table bucketed by document.

    A word is in no more documents than its surfaces together, so which words can
    reach ``min_df`` follows from a sum over the vocabulary.  Only their surfaces
    meet the counts, which then stay with their documents (in their ``buckets``, but for rare
    surfaces, :func:`lexmesh.operators.util.in_place_join`).  The other words are pruned without their ``df``."""
    n_docs = docs.select(id_col).count()
    n = F.lit(n_docs).cast("double")
    lo, hi = df_bounds(min_df, max_df, n)
    mapping = materialize(mapping.select("surface", F.col(col).alias("norm")), "mapping")
    of = document_frequency(surfaces, col).withColumnRenamed(col, "surface")
    most = materialize(mapping.join(of, "surface").groupBy("norm").agg(F.sum("df").alias("most")), "most")
    known = mapping.join(most.where(F.col("most") >= lo), "norm", "left_semi").join(of, "surface")
    known = materialize(known.select(F.col("surface").alias(col), "norm", "df"), "known")
    tf = in_place_join(surfaces.select(id_col, col), known, col, "df", id_col, buckets).select(
        id_col, F.col("norm").alias(col)).distinct()
    dfs = materialize(document_frequency(tf, col))
    vocab = (dfs.where((F.col("df") >= lo) & (F.col("df") <= hi))
                .withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0))
    pruned = most.select(F.col("norm").alias(col)).join(vocab.select(col), col, "left_anti")
    return TfidfModel(vocab=vocab, n_docs=n_docs, min_df=min_df, max_df=max_df, pruned=pruned)


def tfidf_transform(tokens: DataFrame, vocab: DataFrame, id_col: str = "doc_id",
                    col: str = "word", normalize: bool = True, counted: bool = False,
                    buckets: int | None = None) -> DataFrame:
    """``tf * idf`` over the fitted vocabulary, L2-normalised per document
    (A4).  Output ``(doc_id, word, tf, weight)``.  ``counted=True``:
    ``tokens`` already is a term-frequency table ``(doc_id, word, tf)``, in ``buckets`` by
    document: only counts of rare words move then."""
    tf = tokens if counted else term_frequency(tokens, id_col, col)
    if buckets:
        return weighted(in_place_join(tf, vocab.select(col, "idf", "df"), col, "df", id_col, buckets), id_col, col, normalize)
    # with a vocabulary of bounded bytes, counts stay with their documents
    return weighted(tf.join(sent_if_small(vocab.select(col, "idf")), col), id_col, col, normalize)


def weighted(counted: DataFrame, id_col: str = "doc_id", col: str = "word", normalize: bool = True) -> DataFrame:
    """Weights of counts that have their ``idf`` (A4)."""
    x = counted.withColumn("x", F.col("tf") * F.col("idf"))
    if not normalize:
        return x.select(id_col, col, "tf", F.col("x").alias("weight"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(id_col)))
    return x.select(id_col, col, "tf", (F.col("x") / norm).alias("weight"))


def vocab_index(vocab: DataFrame, col: str = "word") -> DataFrame:
    """Term -> 0-based index in sorted term order (N5), computed without a
    single-partition window."""
    return global_row_number(vocab, [F.col(col)], name="idx")


def document_terms(tfidf: DataFrame, id_col: str = "doc_id", col: str = "word") -> DataFrame:
    """Sorted terms with non-zero weight per document."""
    return (tfidf.where(F.col("weight") != 0)
                 .groupBy(id_col).agg(F.array_sort(F.collect_set(col)).alias("terms")))


def keep_vocabulary(lexicon_terms: DataFrame, vocab: DataFrame, col: str = "word") -> DataFrame:
    """Distinct union of lexicon words and the tf-idf vocabulary."""
    return lexicon_terms.select(F.col("term").alias(col)).union(vocab.select(col)).distinct()


def full_vocabulary_count(lexicon: DataFrame, vocab: DataFrame,
                          support_lexicon: DataFrame | None = None) -> DataFrame:
    """Number of distinct words the model considers."""
    words = keep_vocabulary(lexicon, vocab)
    if support_lexicon is not None:
        words = words.union(support_lexicon.select(F.col("term").alias("word"))).distinct()
    return words.agg(F.count(F.lit(1)).alias("n_words"))


def effective_stop_words(stopwords: DataFrame, model: TfidfModel, col: str = "word") -> DataFrame:
    """Stopwords union terms removed by the df limits."""
    return stopwords.select(F.col("word").alias(col)).union(model.pruned.select(col)).distinct()
