"""Inputs derived from the driver's tables, identically in Spark and DuckDB.

The corpus is ``documents``; word vectors, lexica and annotations are
derived from it and from ``embeddings`` by fixed rules, so every derived
table grows with the data:

* tokens: ``split(lower(text), '[^\\p{L}]+')`` without empty strings;
* word vectors: words ranked by (document frequency desc, word); the word
  of rank ``r`` takes the embedding with ``vec_id = r`` (cast to double);
* category lexicon: category ``c<label % 4>`` (0, 1 main; 2, 3 support), so
  every labelled word is a term, ``pos`` = rank of the word in its category
  by ``vec_id``;
* polarity lexicon: the same words, weight by category, ``pos`` = ``vec_id``;
* annotations: hashed from the surface form (see ``derive_annotations``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmesh.operators import counts as CN
from lexmesh.operators.tokens import analyze, clean_docs, derive_annotations, stopword_list, tokenize
from lexmesh.operators.util import global_row_number, spread, text_parts
from lexmesh.session import materialize

# ---------------------------------------------------------------------------
# Fixed values of the derived fixtures (labels are taken modulo 4).
MAIN_LABELS = [0, 1]
SUPPORT_LABELS = [2, 3]
POLARITY_BY_LABEL = {0: 0.9, 1: 0.7, 2: -0.7, 3: -0.9}
# Ranks that share a head's vector, and the share of the own one: first, and more for each.
GROUP, GROUP_SHARE = 5, (0.3, 0.2)
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", parts=_parts(spark, sf_dir))


def letter_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(docs(spark, sf_dir), mode="letters", lower=True)


def word_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(word, df)``: documents per lower-cased letter token."""
    tf = letter_tokens(spark, sf_dir).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    return tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def word_vectors(spark: SparkSession, sf_dir: str, with_meta: bool = False) -> DataFrame:
    """``(word, vec array<double>)`` (+ ``label, vec_id`` with ``with_meta``)."""
    # the vocabulary is written once: ranking samples it and reads it twice
    ranked = global_row_number(materialize(word_doc_freq(spark, sf_dir)),
                               [F.desc("df"), F.asc("word")], name="vec_id")
    emb = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
    out = ranked.join(emb, "vec_id")
    cols = ["word", "vec", "label", "vec_id"] if with_meta else ["word", "vec"]
    return out.select(*cols)


# Derived *input* tables (they stand in for the reference's given inputs:
# a pretrained vector file, lexicon files, a tagger's output) are written
# once per session and data folder and reused by every query.
_INPUTS: dict = {}


def _memo(spark: SparkSession, sf_dir: str, name: str, build, write=materialize):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _INPUTS:
        _INPUTS[key] = write(build(), name)
    return _INPUTS[key]


def _written(found, name: str):
    """For builders that write their table themselves, or that have none."""
    return found


def _parts(spark: SparkSession, sf_dir: str) -> int | None:
    """Partitions of the corpus, from one read of its texts."""
    return _memo(spark, sf_dir, "parts", lambda: text_parts(table(spark, sf_dir, "documents")), _written)


def word_vectors_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vectors with ``label, vec_id``, written once (vocabulary-sized)."""
    return _memo(spark, sf_dir, "word_vectors",
                 lambda: word_vectors(spark, sf_dir, with_meta=True))


def grouped_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vectors with clusters, for the cluster queries: five neighbouring ranks
    share the vector of the first of them, each plus its own vector in a share
    that grows along the five, so that some are similar through others only.
    Columns as :func:`word_vectors_meta`."""
    def build():
        wv = word_vectors_meta(spark, sf_dir)
        nth = F.col("vec_id") % GROUP
        heads = wv.where(nth == 0).select(F.col("vec_id").alias("head_id"), F.col("vec").alias("head"))
        share = F.lit(GROUP_SHARE[0]) + F.lit(GROUP_SHARE[1]) * nth
        rows = wv.withColumns({"head_id": F.col("vec_id") - nth, "share": share}).join(heads, "head_id")
        mixed = F.transform(F.arrays_zip("head", "vec"), lambda p: p["head"] + F.col("share") * p["vec"])
        return rows.select("word", mixed.alias("vec"), "label", "vec_id")
    return _memo(spark, sf_dir, "grouped_vectors", build)


def prepare_inputs(spark: SparkSession, sf_dir: str) -> None:
    """Derive the input tables for ``sf_dir`` up front (bench set-up)."""
    word_vectors_meta(spark, sf_dir)
    analyzed_tf(spark, sf_dir)


def category_lexicon(spark: SparkSession, sf_dir: str, labels=None, wv=None) -> DataFrame:
    labels = labels if labels is not None else MAIN_LABELS + SUPPORT_LABELS
    wv = wv if wv is not None else word_vectors(spark, sf_dir, with_meta=True)
    wv = wv.withColumn("label", F.col("label") % 4).where(F.col("label").isin(labels))
    pos = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return wv.select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"),
                     pos.cast("int").alias("pos"), F.col("word").alias("term"))


def main_lexicon(spark, sf_dir, wv=None):
    return category_lexicon(spark, sf_dir, MAIN_LABELS, wv)


def support_lexicon(spark, sf_dir, wv=None):
    return category_lexicon(spark, sf_dir, SUPPORT_LABELS, wv)


def polarity_lexicon(spark: SparkSession, sf_dir: str, wv=None) -> DataFrame:
    wv = wv if wv is not None else word_vectors(spark, sf_dir, with_meta=True)
    wv = wv.withColumn("label", F.col("label") % 4).where(F.col("label").isNotNull())
    weight = F.create_map(*[x for k, v in POLARITY_BY_LABEL.items()
                            for x in (F.lit(k), F.lit(float(v)))])[F.col("label")]
    return wv.select(F.col("vec_id").cast("int").alias("pos"), F.col("word").alias("term"),
                     weight.alias("weight"))


def cleaned_docs(spark: SparkSession, sf_dir: str, clean: bool = True) -> DataFrame:
    """The corpus after the default cleaning rules (F2), which come before
    the analyzer in the tf-idf pipeline."""
    corpus = docs(spark, sf_dir)
    return clean_docs(corpus) if clean else corpus


def surface_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter tokens as written (no lower-casing): the analyzer's input."""
    return tokenize(cleaned_docs(spark, sf_dir), mode="letters", lower=False)


def surface_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, word, n)`` of the cleaned corpus, written once, bucketed by
    document: the corpus is cleaned and moved once for all queries."""
    return _memo(spark, sf_dir, "surfaces", lambda: CN.surface_counts(
        table(spark, sf_dir, "documents"), parts=_parts(spark, sf_dir)), _written)


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation table for every distinct surface form of the corpus, from the surface
    counts if a query has them written, else from the tokens in place."""
    def build():
        if (spark.sparkContext.applicationId, sf_dir, "surfaces") in _INPUTS:
            return derive_annotations(CN.distinct_surfaces(surface_counts(spark, sf_dir)))
        return derive_annotations(CN.distinct_surfaces(surface_tokens(spark, sf_dir)))
    return _memo(spark, sf_dir, "annotations", build)


def analyzed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 -> P8 -> P9 -> J6 over the corpus: ``(doc_id, tok_pos, ..., word)``."""
    return analyze(cleaned_docs(spark, sf_dir), annotations(spark, sf_dir), stopword_list(spark))


def analyzed_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term counts of the analyzer's output ``(doc_id, word, tf)``, written once,
    bucketed by document."""
    def build():
        return CN.term_counts(surface_counts(spark, sf_dir), annotations(spark, sf_dir), stopword_list(spark),
                              tf_buckets(spark, sf_dir))
    return _memo(spark, sf_dir, "tf", build, _written)


def tf_buckets(spark: SparkSession, sf_dir: str) -> int:
    """Buckets of :func:`analyzed_tf`, as many as the surface counts have."""
    return CN.text_buckets(table(spark, sf_dir, "documents"), _parts(spark, sf_dir) or 1)


def sql_stopwords() -> str:
    from lexmesh.functions.text import german_stopwords
    words = list(german_stopwords()) + [" ", ""]
    return "SELECT unnest([" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]) AS word"


def sql_analyzer_ctes() -> dict:
    from lexmesh.functions.rules import sql_clean_expr
    from lexmesh.functions.text import LEMMA_PUNCT
    punct = LEMMA_PUNCT.replace("'", "''")
    return {
        "cleaned": f"SELECT doc_id, {sql_clean_expr('text')} AS text FROM documents",
        "raw_toks": (
            "SELECT doc_id, word AS surface FROM (SELECT doc_id, "
            "unnest(regexp_split_to_array(text, '[^\\p{L}]+')) AS word FROM cleaned) "
            "WHERE word <> ''"),
        "annotated": (
            "SELECT doc_id, surface, surface AS lemma, "
            "['ADJ', 'ADV', 'NOUN', 'VERB', 'OTHER'][(u % 5) + 1] AS upos, "
            "CASE WHEN u % 50 = 0 THEN 'PER' WHEN u % 50 = 1 THEN 'LOC' END AS ent_type "
            "FROM (SELECT doc_id, surface, ('0x' || substr(md5(surface), 1, 8))::BIGINT AS u "
            "FROM raw_toks)"),
        "filtered": ("SELECT * FROM annotated WHERE upos IN ('ADJ', 'ADV', 'NOUN', 'VERB') "
                     "AND coalesce(ent_type, '') NOT IN ('PER', 'LOC')"),
        "normalized": (
            "SELECT doc_id, surface, upos, CASE WHEN upos = 'NOUN' THEN "
            "(CASE WHEN substr(l, 1, 1) = 'ß' THEN 'Ss' ELSE upper(substr(l, 1, 1)) END) "
            "|| lower(substr(l, 2)) ELSE lower(l) END AS word FROM "
            f"(SELECT doc_id, surface, upos, regexp_replace(lemma, '{punct}', '', 'g') AS l "
            "FROM filtered)"),
        "normalized_ok": ("SELECT * FROM normalized WHERE NOT contains(word, 'xcx') AND "
                          "NOT contains(word, 'Xcx') AND NOT contains(word, '5')"),
        "stopwords": sql_stopwords(),
        "analyzed": ("SELECT doc_id, word FROM normalized_ok "
                     "WHERE word NOT IN (SELECT word FROM stopwords)"),
        "tf": "SELECT doc_id, word, count(*) AS tf FROM analyzed GROUP BY doc_id, word",
        "dfs": "SELECT word, count(*) AS df FROM tf GROUP BY word",
        "n_docs": "SELECT count(*) AS n FROM documents",
        "vocab": ("SELECT word, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM dfs, n_docs "
                  "WHERE df >= 5 AND df <= 0.95 * n"),
        "tfidf": ("SELECT doc_id, word, tf, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) "
                  "AS weight FROM (SELECT t.doc_id, t.word, t.tf, t.tf * v.idf AS x "
                  "FROM tf t JOIN vocab v ON v.word = t.word)"),
        "top3": ("SELECT doc_id, word, weight, rnk, weight / sum(weight) OVER (PARTITION BY doc_id) "
                 "AS norm_weight FROM (SELECT doc_id, word, weight, row_number() OVER "
                 "(PARTITION BY doc_id ORDER BY weight DESC, word DESC) AS rnk FROM tfidf "
                 "WHERE word IN (SELECT word FROM word_vectors)) WHERE rnk <= 3"),
        "docvec_elems": (
            "SELECT t.doc_id, i, sum(t.norm_weight * x) AS value FROM top3 t JOIN "
            "(SELECT word, unnest(vec) AS x, unnest(generate_series(0, len(vec) - 1)) AS i "
            "FROM word_vectors) w ON w.word = t.word GROUP BY t.doc_id, i"),
        "dim": "SELECT max(len(vec)) AS dim FROM word_vectors",
        "docvec": (
            "SELECT d.doc_id, p.i AS pos, coalesce(e.value, 0.0) AS value FROM documents d "
            "JOIN (SELECT unnest(generate_series(0, dim - 1)) AS i FROM dim) p ON true "
            "LEFT JOIN docvec_elems e ON e.doc_id = d.doc_id AND e.i = p.i"),
    }


# --- DuckDB forms -----------------------------------------------------------

_WEIGHT_CASE = "CASE label % 4 " + " ".join(
    f"WHEN {k} THEN {v}" for k, v in POLARITY_BY_LABEL.items()) + " END"

SQL_FIXTURES = {
    "docs": "SELECT doc_id, text FROM documents",
    "letter_tokens": (
        "SELECT doc_id, word FROM (SELECT doc_id, "
        "unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS word FROM documents) "
        "WHERE word <> ''"),
    "word_df": "SELECT word, count(DISTINCT doc_id) AS df FROM letter_tokens GROUP BY word",
    "ranked": ("SELECT word, df, row_number() OVER (ORDER BY df DESC, word) - 1 AS vec_id "
               "FROM word_df"),
    "word_vectors": (
        "SELECT r.word, CAST(e.embedding AS DOUBLE[]) AS vec, e.label, r.vec_id "
        "FROM ranked r JOIN embeddings e ON e.vec_id = r.vec_id"),
    "category_lexicon": (
        "SELECT 'c' || CAST(label % 4 AS VARCHAR) AS category, "
        "CAST(row_number() OVER (PARTITION BY label % 4 ORDER BY vec_id) - 1 AS INTEGER) AS pos, "
        "word AS term FROM word_vectors WHERE label IS NOT NULL"),
    "main_lexicon": "SELECT * FROM category_lexicon WHERE category IN ('c0', 'c1')",
    "support_lexicon": "SELECT * FROM category_lexicon WHERE category IN ('c2', 'c3')",
    "polarity_lexicon": (
        f"SELECT CAST(vec_id AS INTEGER) AS pos, word AS term, CAST({_WEIGHT_CASE} AS DOUBLE) "
        "AS weight FROM word_vectors WHERE label IS NOT NULL"),
    # unit vectors and the polarity axis (naive form: mean of weighted cosines
    # is computed per element, then summed)
    "word_units": (
        "SELECT word, vec, CASE WHEN nrm = 0 THEN list_transform(vec, lambda x: 0.0) "
        "ELSE list_transform(vec, lambda x: x / nrm) END AS u FROM (SELECT word, vec, "
        "sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS nrm FROM word_vectors)"),
    "seeds": ("SELECT p.pos, p.term, p.weight, w.u FROM polarity_lexicon p "
              "LEFT JOIN word_units w ON w.word = p.term"),
    "axis": ("SELECT i, sum(weight * x) / (SELECT count(*) FROM seeds) AS a FROM "
             "(SELECT weight, unnest(u) AS x, unnest(generate_series(1, len(u))) AS i "
             "FROM seeds WHERE u IS NOT NULL) GROUP BY i"),
    "word_pol": ("SELECT word, sum(x * a) AS pol FROM (SELECT word, unnest(u) AS x, "
                 "unnest(generate_series(1, len(u))) AS i FROM word_units) JOIN axis USING (i) "
                 "GROUP BY word"),
}


#: ``word_vectors`` as :func:`grouped_vectors` has them.
SQL_GROUPED = {"word_vectors": (
    "SELECT r.word, list_transform(list_zip(h.embedding, e.embedding), lambda p: CAST(p[1] AS DOUBLE) + "
    f"CAST({GROUP_SHARE[0]} + {GROUP_SHARE[1]} * (r.vec_id % {GROUP}) AS DOUBLE) * CAST(p[2] AS DOUBLE)) AS vec, "
    "e.label, r.vec_id FROM ranked r JOIN embeddings e ON e.vec_id = r.vec_id "
    f"JOIN embeddings h ON h.vec_id = r.vec_id - r.vec_id % {GROUP} "
    f"AND h.vec_id IN (SELECT vec_id FROM ranked)")}


def with_fixtures(body: str, extra_ctes: str = "", recursive: bool = False, instead: dict | None = None):
    """A query prefixed with every fixture CTE (DuckDB ignores unused ones)
    and with ``extra_ctes`` (``name AS (...)`` items, comma separated).
    ``instead`` replaces fixtures by name.

    Returns a function without arguments: the text is put together when
    ``oracle_sql()`` asks for it, so importing the query modules reads no
    file and builds no SQL."""
    def sql() -> str:
        ctes = {**SQL_FIXTURES, **sql_analyzer_ctes(), **(instead or {})}
        parts = ",\n".join(f"{k} AS ({v})" for k, v in ctes.items())
        if extra_ctes.strip():
            parts += ",\n" + extra_ctes.strip().rstrip(",")
        return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{body}"
    return sql
