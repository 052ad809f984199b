"""Tokenisation, annotation join, token filters and stopwords.

All operators are narrow (map-side) except the annotation / stopword /
vocabulary joins, which are equi-joins on the token string.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmesh.functions.rules import DEFAULT_RULES
from lexmesh.functions.text import (BAD_TOKEN_PARTS, DROPPED_ENTITIES, LEMMA_PUNCT,
                                    LETTER_SPLIT, RELEVANT_POS, WHITESPACE_SPLIT,
                                    apply_rules, capitalize, german_stopwords)


def clean_docs(docs: DataFrame, rules=DEFAULT_RULES, text_col: str = "text") -> DataFrame:
    """The cleaner (F2) as the first stage of the tf-idf pipeline."""
    return docs.withColumn(text_col, apply_rules(F.col(text_col).cast("string"), rules))


def tokenize(docs: DataFrame, id_cols=("doc_id",), text_col: str = "text",
             mode: str = "letters", lower: bool = True, out_col: str = "word") -> DataFrame:
    """One row per token: ``(*id_cols, tok_pos, word)``.

    ``mode="letters"`` splits on runs of non-letters (``lower`` applies);
    ``mode="whitespace"`` splits on whitespace and keeps the token as written
    (the all-words scoring path looks up raw whitespace tokens).
    Empty strings are dropped; ``tok_pos`` is the position in the split.
    """
    text = F.col(text_col)
    if mode == "letters":
        arr = F.split(F.lower(text) if lower else text, LETTER_SPLIT)
    elif mode == "whitespace":
        arr = F.split(text, WHITESPACE_SPLIT)
    else:
        raise ValueError(f"unknown tokenizer mode {mode!r}")
    ids = [F.col(c) for c in id_cols]
    return (docs.select(*ids, F.posexplode(arr).alias("tok_pos", out_col))
                .where(F.col(out_col) != ""))


def derive_annotations(surfaces: DataFrame, surface_col: str = "surface") -> DataFrame:
    """Annotation table from a hash of the surface form (test fixture rule).

    ``upos`` = ADJ/ADV/NOUN/VERB/OTHER by ``u % 5``; ``ent_type`` = PER for
    ``u % 50 == 0``, LOC for ``u % 50 == 1``; ``lemma`` = surface.
    """
    from lexmesh.functions.hashing import hash_u
    u = hash_u(surface_col)
    upos = F.element_at(F.array(*[F.lit(x) for x in ["ADJ", "ADV", "NOUN", "VERB", "OTHER"]]),
                        (u % 5 + 1).cast("int"))
    ent = F.when(u % 50 == 0, F.lit("PER")).when(u % 50 == 1, F.lit("LOC"))
    return surfaces.select(F.col(surface_col).alias("surface"),
                           F.col(surface_col).alias("lemma"), upos.alias("upos"),
                           ent.alias("ent_type"))


def annotate_tokens(tokens: DataFrame, annotations: DataFrame,
                    token_col: str = "word") -> DataFrame:
    """Attach ``lemma, upos, ent_type`` per token by a left join on the
    surface form (P7).  Unannotated surface: lemma = surface, upos null.

    ``tokens`` may also be counted tokens ``(doc_id, word, n)``, which is one
    row per document and surface form instead of one per occurrence.  The
    join is left to the planner, which decides by bytes at run time and
    splits hot tokens (skew join)."""
    ann = annotations.select("surface", "lemma", "upos", "ent_type")
    joined = tokens.join(ann, tokens[token_col] == ann["surface"], "left")
    return joined.select(*[tokens[c] for c in tokens.columns],
                         F.coalesce(F.col("lemma"), tokens[token_col]).alias("lemma"),
                         F.col("upos"), F.col("ent_type")).withColumnRenamed(token_col, "surface")


def filter_tokens(tokens: DataFrame, relevant_pos: Iterable[str] = RELEVANT_POS,
                  dropped_entities: Iterable[str] = DROPPED_ENTITIES) -> DataFrame:
    """Keep tokens whose ``upos`` is relevant and whose entity type is not
    dropped (P8)."""
    return tokens.where(F.col("upos").isin(list(relevant_pos))
                        & ~F.coalesce(F.col("ent_type"), F.lit("")).isin(list(dropped_entities)))


def normalize_tokens(tokens: DataFrame, out_col: str = "word") -> DataFrame:
    """Strip punctuation from the lemma, capitalise nouns, lower the rest,
    drop tokens containing a bad part (P9).  Stopwords: :func:`anti_stopwords`."""
    stripped = F.regexp_replace(F.col("lemma"), LEMMA_PUNCT, "")
    word = F.when(F.col("upos") == "NOUN", capitalize(stripped)).otherwise(F.lower(stripped))
    out = tokens.withColumn(out_col, word)
    cond = F.lit(True)
    for part in BAD_TOKEN_PARTS:
        cond = cond & ~F.col(out_col).contains(part)
    return out.where(cond)


def stopword_list(spark: SparkSession, extra_path: str | None = None,
                  extra_words: Iterable[str] = ()) -> DataFrame:
    """German stopwords, plus ``" "`` and ``""``, plus custom words (trimmed,
    unique) from a text file and/or a list (P10)."""
    base = spark.createDataFrame([(w,) for w in (*german_stopwords(), " ", "", *extra_words)],
                                 "word string")
    if extra_path:
        custom = spark.read.text(extra_path).select(F.trim(F.col("value")).alias("word"))
        base = base.unionByName(custom)
    return base.distinct()


def anti_stopwords(tokens: DataFrame, stopwords: DataFrame, col: str = "word") -> DataFrame:
    """Tokens (or counted tokens) not in the stopword set."""
    sw = stopwords.select(F.col("word").alias(col)).distinct()
    return tokens.join(sw, col, "left_anti")


def tokens_in_vocabulary(tokens: DataFrame, word_vectors: DataFrame,
                         col: str = "word") -> DataFrame:
    """Tokens (or counted tokens) that have a vector, with multiplicity."""
    keys = word_vectors.select(F.col("word").alias(col))
    return tokens.join(keys, col, "left_semi")


def count_tokens(tokens: DataFrame, id_cols=("doc_id",), col: str = "word") -> DataFrame:
    """``(*id_cols, word, n)``: occurrences per document, so that a join on
    the word moves one row for each instead of one per occurrence."""
    return tokens.groupBy(*id_cols, col).agg(F.count(F.lit(1)).alias("n"))


def analyze(docs: DataFrame, annotations: DataFrame, stopwords: DataFrame,
            id_cols=("doc_id",), text_col: str = "text",
            relevant_pos: Iterable[str] = RELEVANT_POS) -> DataFrame:
    """P7 -> P8 -> P9 -> J6: the analyzer feeding tf-idf.  Output
    ``(*id_cols, tok_pos, surface, lemma, upos, ent_type, word)``."""
    toks = tokenize(docs, id_cols=id_cols, text_col=text_col, mode="letters", lower=False)
    ann = annotate_tokens(toks, annotations)
    return anti_stopwords(normalize_tokens(filter_tokens(ann, relevant_pos)), stopwords)


def prepare_annotations(annotations: DataFrame, stopwords: DataFrame,
                        relevant_pos: Iterable[str] = RELEVANT_POS) -> DataFrame:
    """``surface -> word`` for every annotated surface form that survives
    P8 (POS / entity filter), P9 (normalisation, bad parts) and J6
    (stopwords).  All of these depend on the surface form only, so they run
    once per vocabulary entry instead of once per token."""
    kept = normalize_tokens(filter_tokens(annotations, relevant_pos))
    kept = anti_stopwords(kept, stopwords)
    return kept.select("surface", "word")


def analyzed_term_frequency(docs: DataFrame, annotations: DataFrame, stopwords: DataFrame,
                            id_cols=("doc_id",), text_col: str = "text",
                            relevant_pos: Iterable[str] = RELEVANT_POS) -> DataFrame:
    """Term counts of the analyzer's output, ``(*id_cols, word, tf)``.

    Same result as counting :func:`analyze`'s tokens, with two rewrites:
    surfaces are counted per document first (map-side partial
    aggregation), and the per-surface analysis (P8, P9, J6) is applied to
    the vocabulary-sized annotation table (:func:`prepare_annotations`), so
    the corpus side only does one equi-join and a sum.  A surface without
    an annotation has no POS tag and is dropped by P8 either way."""
    toks = tokenize(docs, id_cols=id_cols, text_col=text_col, mode="letters", lower=False)
    return analyzed_counts(count_tokens(toks, id_cols), annotations, stopwords, id_cols, relevant_pos)


def analyzed_counts(surfaces: DataFrame, annotations: DataFrame, stopwords: DataFrame,
                    id_cols=("doc_id",), relevant_pos: Iterable[str] = RELEVANT_POS,
                    spread=None) -> DataFrame:
    """:func:`analyzed_term_frequency` from surface counts ``(*id_cols, word, n)``.
    ``spread`` partitions the joined rows before they are added up."""
    mapping = prepare_annotations(annotations, stopwords, relevant_pos).withColumnRenamed("word", "norm")
    joined = surfaces.join(mapping, surfaces["word"] == mapping["surface"]) \
                     .select(*id_cols, F.col("norm").alias("word"), "n")
    return (spread(joined) if spread else joined).groupBy(*id_cols, "word").agg(F.sum("n").alias("tf"))
