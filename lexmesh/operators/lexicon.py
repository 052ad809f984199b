"""Lexicon algebra on the long form ``lexicon(category, pos, term)`` and
``polarity(pos, term, weight)`` (P2-P6, P12, P13, U1, U4, A6-A8, N2).

Lexica are tiny; every operator is a plain DataFrame expression and never
collects.  Missing cells do not exist in the long form (P2 is inherent).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.functions.text import strip_wildcards

LEXICON_SCHEMA = "category string, pos int, term string"
POLARITY_SCHEMA = "pos int, term string, weight double"


def drop_missing_terms(lexicon: DataFrame) -> DataFrame:
    """Keep non-missing cells."""
    return lexicon.where(F.col("term").isNotNull())


def clean_terms(lexicon: DataFrame) -> DataFrame:
    """Strip wildcards from every term (P1 applied to a lexicon)."""
    return lexicon.withColumn("term", strip_wildcards("term"))


def lexicon_category(lexicon: DataFrame, key: str) -> DataFrame:
    """One category's terms in list order."""
    return lexicon.where(F.col("category") == key).select("pos", "term")


def lexicon_set_category(lexicon: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """Add or replace one category (P4); ``terms`` has ``(pos, term)``."""
    new = terms.select(F.lit(key).alias("category"), F.col("pos").cast("int"), "term")
    return lexicon.where(F.col("category") != key).unionByName(new)


def dedupe_last_weight(polarity: DataFrame) -> DataFrame:
    """word -> weight with the last duplicate winning (N2), keeping the
    position of the winning entry."""
    w = Window.partitionBy("term").orderBy(F.desc("pos"))
    return (polarity.withColumn("_rn", F.row_number().over(w))
                    .where(F.col("_rn") == 1).drop("_rn"))


def polarity_weight(polarity: DataFrame, words: DataFrame, col: str = "word",
                    missing: str = "null") -> DataFrame:
    """Weight per requested word (P5).  A word without one gets null, or with
    ``missing="error"`` ends the job that reads the result with its name."""
    if missing not in ("null", "error"):
        raise ValueError(f"unknown choice {missing!r} for missing words")
    w = dedupe_last_weight(polarity).select(F.col("term").alias(col), "weight")
    out = words.join(w, col, "left")
    if missing == "error":
        said = F.raise_error(F.concat(F.lit("no weight for the word "), F.coalesce(F.col(col), F.lit("null"))))
        out = out.withColumn("weight", F.coalesce("weight", said.cast("double")))
    return out


def select_keys(lexicon: DataFrame, support_lexicon: DataFrame | None = None,
                main_keys: Sequence[str] | None = None,
                support_keys: Sequence[str] | None = None) -> DataFrame:
    """Role per category (P6): explicit keys override lexicon keys, keys in
    both lists are main only (U4), categories without a role are dropped.
    Output ``(category, role)``."""
    spark = lexicon.sparkSession

    def keys_frame(keys):
        return spark.createDataFrame([(k,) for k in keys], "category string")

    main = keys_frame(main_keys) if main_keys else lexicon.select("category").distinct()
    if support_keys:
        support = keys_frame(support_keys)
    elif support_lexicon is not None:
        support = support_lexicon.select("category").distinct()
    else:
        support = keys_frame([])
    support = drop_overlapping_keys(support, main)
    return (main.select("category", F.lit("main").alias("role"))
                .unionByName(support.select("category", F.lit("support").alias("role"))))


def merge_lexica(lexica: Iterable[DataFrame]) -> DataFrame:
    """Union of lexica where a category already present is kept as is and
    only new categories are added, whole (U1).  Pure: inputs unchanged."""
    it = iter(lexica)
    out = next(it)
    for other in it:
        new = other.join(out.select("category").distinct(), "category", "left_anti")
        out = out.unionByName(new.select(*out.columns))
    return out


def drop_overlapping_keys(support_keys: DataFrame, main_keys: DataFrame) -> DataFrame:
    """Support keys EXCEPT main keys (U4); both have a ``category`` column."""
    return support_keys.select("category").exceptAll(main_keys.select("category")).distinct()


def vocabulary(lexicon: DataFrame) -> DataFrame:
    """Sorted distinct terms."""
    return lexicon.select("term").distinct()


def polarity_vocabulary(polarity: DataFrame) -> DataFrame:
    """Terms of a polarity lexicon in original order, duplicates kept."""
    return polarity.select("pos", "term")


def lexicon_to_map(lexicon: DataFrame) -> DataFrame:
    """``{category: [terms]}`` as one row per category with the terms in
    list order (A7)."""
    return (lexicon.groupBy("category")
                   .agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("_e"))
                   .select("category", F.transform("_e", lambda e: e["term"]).alias("terms")))


def polarity_to_map(polarity: DataFrame) -> DataFrame:
    """``{word: weight}`` as a one-row map, last duplicate winning."""
    d = dedupe_last_weight(polarity)
    return d.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "weight"))))
                 .alias("weights"))


def lexicon_shape(lexicon: DataFrame, word_vectors: DataFrame | None = None) -> DataFrame:
    """Number of categories and longest category (A8); with vectors also
    the embedding dim, so ``embedding_shape`` = (max_rows, n_categories, dim)."""
    if word_vectors is None:
        per_cat = lexicon.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
        return per_cat.agg(F.count(F.lit(1)).alias("n_categories"), F.max("n").alias("max_rows"))
    from lexmesh.operators.vectors import embed_lexicon
    per_cat = (embed_lexicon(lexicon, word_vectors).groupBy("category")
               .agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")))
    return per_cat.agg(F.count(F.lit(1)).alias("n_categories"), F.max("n").alias("max_rows"),
                       F.max("d").alias("dim"))


def threshold_predictions(proba: DataFrame, cutoff: float = 0.5, col: str = "proba") -> DataFrame:
    """Binary prediction ``proba >= cutoff`` (P12, classifier semantics)."""
    return proba.withColumn("prediction", (F.col(col) >= F.lit(cutoff)).cast("int"))


def ensemble_predict(proba: DataFrame, cutoff: float = 0.5, col: str = "proba") -> DataFrame:
    """Binary prediction ``proba > cutoff`` (P13, ensemble semantics)."""
    return proba.withColumn("prediction", (F.col(col) > F.lit(cutoff)).cast("int"))


def wide_predictions(pred: DataFrame, categories: Sequence[str], id_col: str = "id",
                     value_col: str = "prediction") -> DataFrame:
    """One int column per main category, in ``categories`` order."""
    return (pred.groupBy(id_col).pivot("category", list(categories)).agg(F.first(value_col))
                .select(id_col, *categories))
