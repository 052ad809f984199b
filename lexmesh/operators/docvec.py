"""tf-idf-weighted document vectors (N1, A5, F7 use).

Order of work (survey §4 "top-k pruning before aggregation"): tf-idf rows
are semi-joined to the vector *keys*, the top-n words per document are
chosen with ``row_number`` (Spark prunes it per partition before the
shuffle: ``WindowGroupLimit``), and vectors are fetched for the survivors
only.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.functions.vectors import linear_combination, zeros
from lexmesh.operators.util import sent_if_small

# Above this many words per document the weighted sum is computed with a
# partial-aggregating vector aggregate instead of a per-document array.
ARRAY_PATH_MAX_WORDS = 32


def top_words_per_doc(tfidf: DataFrame, n: int | None = 3, id_col: str = "doc_id",
                      col: str = "word", weight_col: str = "weight") -> DataFrame:
    """Keep the ``n`` highest-weight words per document, ties going to the
    lexicographically larger word, and renormalise the kept weights to sum
    1 (N1).  ``n=None`` keeps every word."""
    out = tfidf
    if n is not None:
        w = Window.partitionBy(id_col).orderBy(F.desc(weight_col), F.desc(col))
        out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    total = F.sum(weight_col).over(Window.partitionBy(id_col))
    return out.withColumn("norm_weight", F.col(weight_col) / total)


def doc_vectors_weighted(tfidf: DataFrame, word_vectors: DataFrame, n_top: int | None = 3,
                         docs: DataFrame | None = None, dim: int | None = None,
                         id_col: str = "doc_id", col: str = "word",
                         method: str = "auto") -> DataFrame:
    """Document vector = Σ ŵ·v over the top-n words that have a vector (A5).

    ``method="array"`` gathers the (at most ``n_top``) weighted vectors of a
    document and folds them with F7; ``"summarizer"`` uses Spark ML's
    weighted ``Summarizer.mean`` (fixed-size partial aggregates, safe for
    any number of words).  With ``docs`` and ``dim`` given, documents
    without words get a zero vector."""
    # of bounded bytes, words with a vector go to the documents' weights, and vectors to the top words
    keys = sent_if_small(word_vectors.select(F.col("word").alias(col)))
    cand = tfidf.join(keys, col, "left_semi")
    top = top_words_per_doc(cand, n_top, id_col, col)
    with_vec = top.join(sent_if_small(word_vectors.withColumnRenamed("word", col)), col)
    if method == "auto":
        method = "array" if n_top is not None and n_top <= ARRAY_PATH_MAX_WORDS else "summarizer"
    if method == "array":
        grouped = with_vec.groupBy(id_col).agg(
            F.collect_list(F.struct("norm_weight", "vec")).alias("_items"))
        vecs = grouped.select(id_col, linear_combination(
            F.transform("_items", lambda e: e["vec"]),
            F.transform("_items", lambda e: e["norm_weight"])).alias("vec"))
    else:
        agg = with_vec.groupBy(id_col).agg(
            Summarizer.mean(array_to_vector("vec"), F.col("norm_weight")).alias("_m"))
        vecs = agg.select(id_col, vector_to_array("_m").alias("vec"))
    if docs is not None:
        if dim is None:
            raise ValueError("dim is required to give empty documents a zero vector")
        vecs = (docs.select(id_col).join(vecs, id_col, "left")
                    .withColumn("vec", F.coalesce(F.col("vec"), zeros(dim))))
    return vecs


def explode_vectors(vecs: DataFrame, id_cols=("doc_id",), vec_col: str = "vec",
                    digits: int = 6) -> DataFrame:
    """Arrays as ``(id, pos, value)`` rows, values rounded (comparison form)."""
    return vecs.select(*id_cols, F.posexplode(vec_col).alias("pos", "value")) \
               .withColumn("value", F.round("value", digits))
