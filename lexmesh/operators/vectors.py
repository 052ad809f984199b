"""Word-vector joins (J1-J3, F9, S6 checks).

``word_vectors(word string, vec array<double>)`` with ``word`` unique.  The
vector table is vocabulary-sized; lexica are tiny and broadcast behind a
row-count check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.functions.vectors import zeros


def as_word_vectors(df: DataFrame, word_col: str = "word", vec_col: str = "vec") -> DataFrame:
    """Normalise a vector table to ``(word, vec array<double>)``."""
    return df.select(F.col(word_col).alias("word"), F.col(vec_col).cast("array<double>").alias("vec"))


def check_word_vectors(word_vectors: DataFrame) -> DataFrame:
    """One-row report used to validate a vector table (S6): number of
    words, distinct words and distinct dimensions.  Valid iff
    ``n_words == n_distinct`` and ``n_dims == 1``."""
    return word_vectors.agg(
        F.count(F.lit(1)).alias("n_words"),
        F.countDistinct("word").alias("n_distinct"),
        F.countDistinct(F.size("vec")).alias("n_dims"),
        F.max(F.size("vec")).alias("dim"))


def embed_lexicon(lexicon: DataFrame, word_vectors: DataFrame, term_col: str = "term") -> DataFrame:
    """Vector per lexicon term; a term without a vector gets a null ``vec``
    (J1).  The lexicon side is the small one."""
    return lexicon.join(word_vectors.withColumnRenamed("word", term_col), term_col, "left")


def filter_vectors(word_vectors: DataFrame, terms: DataFrame, col: str = "word") -> DataFrame:
    """Restrict vectors to a vocabulary (J2): a semi join, so duplicate
    terms never duplicate vectors."""
    keys = terms.select(F.col(col).alias("word")).where(F.col("word").isNotNull())
    return word_vectors.join(keys, "word", "left_semi")


def lookup_vectors(words: DataFrame, word_vectors: DataFrame, dim: int | None = None,
                   missing: str = "zero", col: str = "word") -> DataFrame:
    """Vector for each requested word (J3).  ``missing="zero"``: a word
    without a vector gets a zero vector of length ``dim``; ``"null"`` keeps
    null; ``"drop"`` removes the word."""
    wv = word_vectors.withColumnRenamed("word", col)
    if missing == "drop":
        return words.join(wv, col, "inner")
    out = words.join(wv, col, "left")
    if missing == "zero":
        if dim is None:
            raise ValueError("dim is required for missing='zero'")
        out = out.withColumn("vec", F.coalesce(F.col("vec"), zeros(dim)))
    return out


def flatten_terms(terms_matrix: DataFrame, col: str = "terms") -> DataFrame:
    """Unique non-missing values of an array-of-arrays / array column."""
    c = F.col(col)
    arr = F.flatten(c) if terms_matrix.schema[col].dataType.elementType.typeName() == "array" else c
    return (terms_matrix.select(F.explode(arr).alias("term"))
                        .where(F.col("term").isNotNull()).distinct())

