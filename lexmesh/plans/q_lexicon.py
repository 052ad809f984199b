"""Registered queries: lexicon sources, algebra and vector joins
(S1-S6, S8, P1-P6, P12, P13, U1, U4, A6-A8, N2, J1-J3, F3, F5, F8, F9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmesh.functions import text as T
from lexmesh.functions.hashing import hash_u, sql_hash_u
from lexmesh.functions.vectors import norm, pad_list
from lexmesh.operators import lexicon as L
from lexmesh.operators import vectors as V
from lexmesh.plans import fixtures as fx
from lexmesh.plans.fixtures import with_fixtures as W
from lexmesh.operators.util import global_row_number
from lexmesh.plans.registry import register
from lexmesh.session import scratch_path
from lexmesh.sources import lexicon_io as IO

CATS = ["c0", "c1", "c2", "c3"]


def _lex(spark, d):
    wvm = fx.word_vectors_meta(spark, d)
    return wvm, fx.category_lexicon(spark, d, wv=wvm)


def _bench_words(spark, d):
    """Distinct lower-cased letter tokens of the ``benchmark`` texts."""
    from lexmesh.operators.tokens import tokenize
    b = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return tokenize(b, mode="letters", lower=True).select("word").distinct()


SQL_BENCH_WORDS = """bench_words AS (SELECT DISTINCT word FROM (SELECT unnest(
    regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS word FROM benchmark) WHERE word <> '')"""

# --- sources ------------------------------------------------------------------


@register("lexicon_from_wide", sql=W("SELECT category, pos, term FROM category_lexicon"))
def q_lexicon_from_wide(spark, d):
    _, lex = _lex(spark, d)
    wide = IO.lexicon_to_wide(lex, CATS)
    return IO.lexicon_from_wide(wide, CATS, pos_col="pos")


@register("lexicon_from_dict", sql=W("SELECT category, pos, term FROM category_lexicon"))
def q_lexicon_from_dict(spark, d):
    _, lex = _lex(spark, d)
    return IO.lexicon_from_arrays(L.lexicon_to_map(lex))


@register("lexicon_from_json", sql=W("SELECT category, pos, term FROM category_lexicon"))
def q_lexicon_from_json(spark, d):
    _, lex = _lex(spark, d)
    path = scratch_path(spark, "lexicon-json")
    IO.write_lexicon_json(lex, path)
    return IO.lexicon_from_json(spark, path)


@register("lexicon_from_csv", sql=W("SELECT category, pos, term FROM category_lexicon"))
def q_lexicon_from_csv(spark, d):
    _, lex = _lex(spark, d)
    path = scratch_path(spark, "lexicon-csv")
    IO.write_lexicon_csv(lex, path, CATS, sep=";")
    return IO.lexicon_from_csv(spark, path, sep=";")


@register("polarity_from_pairs", sql=W("SELECT pos, term, weight FROM polarity_lexicon"))
def q_polarity_from_pairs(spark, d):
    wvm = fx.word_vectors_meta(spark, d)
    pol = fx.polarity_lexicon(spark, d, wvm)
    pairs = pol.select(F.col("term").alias("word"), F.col("weight").alias("value"), "pos")
    return IO.polarity_from_pairs(pairs, order_col="pos")


@register("vectors_from_dict", sql=W(
    "SELECT count(*) AS n_words, count(DISTINCT word) AS n_distinct, "
    "count(DISTINCT len(vec)) AS n_dims, max(len(vec)) AS dim FROM word_vectors"))
def q_vectors_from_dict(spark, d):
    return V.check_word_vectors(fx.word_vectors(spark, d))


@register("corpus_source", sql="SELECT doc_id, text FROM documents")
def q_corpus_source(spark, d):
    from lexmesh.sources.corpus import corpus_source
    return corpus_source(spark, f"{d}/documents.parquet")


# --- projections / filters ------------------------------------------------------

_WILD_SQL = (f"SELECT category, pos, CASE WHEN {sql_hash_u('term')} % 3 = 0 THEN term || '*' "
             "ELSE term END AS raw_term FROM category_lexicon")


@register("strip_wildcards", sql=W(
    "SELECT category, pos, raw_term, replace(raw_term, '*', '') AS term FROM wild",
    f"wild AS ({_WILD_SQL})"))
def q_strip_wildcards(spark, d):
    _, lex = _lex(spark, d)
    wild = lex.select("category", "pos", F.when(hash_u("term") % 3 == 0, F.concat("term", F.lit("*")))
                      .otherwise(F.col("term")).alias("raw_term"))
    return wild.withColumn("term", T.strip_wildcards("raw_term"))


@register("drop_missing_terms", sql=W(
    "SELECT category, count(*) AS n_terms, (SELECT count(DISTINCT pos) FROM category_lexicon) "
    "AS n_cells FROM category_lexicon GROUP BY category"))
def q_drop_missing_terms(spark, d):
    _, lex = _lex(spark, d)
    wide = IO.lexicon_to_wide(lex, CATS)
    cells = wide.unpivot(["pos"], CATS, "category", "term")  # padded cells, nulls included
    kept = L.drop_missing_terms(cells)
    n_cells = cells.groupBy("category").agg(F.count(F.lit(1)).alias("n_cells"))
    return kept.groupBy("category").agg(F.count(F.lit(1)).alias("n_terms")).join(n_cells, "category")


@register("lexicon_category", sql=W("SELECT pos, term FROM category_lexicon WHERE category = 'c1'"))
def q_lexicon_category(spark, d):
    _, lex = _lex(spark, d)
    return L.lexicon_category(lex, "c1")


@register("lexicon_set_category", sql=W(
    "SELECT category, pos, term FROM category_lexicon WHERE category <> 'c1' "
    "UNION ALL SELECT 'c1', pos, term FROM category_lexicon WHERE category = 'c3'"))
def q_lexicon_set_category(spark, d):
    _, lex = _lex(spark, d)
    return L.lexicon_set_category(lex, "c1", L.lexicon_category(lex, "c3"))


@register("polarity_weight", sql=W(
    "SELECT b.word, p.weight FROM bench_words b LEFT JOIN polarity_lexicon p ON p.term = b.word",
    SQL_BENCH_WORDS))
def q_polarity_weight(spark, d):
    wvm = fx.word_vectors_meta(spark, d)
    return L.polarity_weight(fx.polarity_lexicon(spark, d, wvm), _bench_words(spark, d))


@register("select_keys", sql=W(
    "SELECT DISTINCT category, 'main' AS role FROM main_lexicon UNION ALL "
    "SELECT category, 'support' AS role FROM (VALUES ('c1'), ('c2'), ('c3')) t(category) "
    "WHERE category NOT IN (SELECT category FROM main_lexicon)"))
def q_select_keys(spark, d):
    wvm = fx.word_vectors_meta(spark, d)
    return L.select_keys(fx.main_lexicon(spark, d, wvm), fx.support_lexicon(spark, d, wvm),
                         support_keys=["c1", "c2", "c3"])


# --- set operations ---------------------------------------------------------------

@register("merge_lexica", sql=W(
    "SELECT category, pos, term FROM main_lexicon UNION ALL "
    "SELECT category, pos, term FROM support_lexicon"))
def q_merge_lexica(spark, d):
    wvm = fx.word_vectors_meta(spark, d)
    main, sup = fx.main_lexicon(spark, d, wvm), fx.support_lexicon(spark, d, wvm)
    # the second lexicon also carries a different 'c1'; the first one's is kept
    other = sup.unionByName(L.lexicon_set_category(sup, "c1", L.lexicon_category(sup, "c3"))
                            .where(F.col("category") == "c1"))
    return L.merge_lexica([main, other])


@register("drop_overlapping_keys", sql=W(
    "SELECT DISTINCT category FROM category_lexicon WHERE category IN ('c1', 'c2', 'c3') "
    "EXCEPT SELECT DISTINCT category FROM main_lexicon"))
def q_drop_overlapping_keys(spark, d):
    _, lex = _lex(spark, d)
    support = lex.where(F.col("category").isin("c1", "c2", "c3")).select("category").distinct()
    main = lex.where(F.col("category").isin("c0", "c1")).select("category").distinct()
    return L.drop_overlapping_keys(support, main)


# --- aggregations over lexica -------------------------------------------------------

@register("vocabulary", sql=W("SELECT DISTINCT term FROM category_lexicon"))
def q_vocabulary(spark, d):
    _, lex = _lex(spark, d)
    return L.vocabulary(lex)


@register("polarity_vocabulary", sql=W("SELECT pos, term FROM polarity_lexicon"))
def q_polarity_vocabulary(spark, d):
    wvm = fx.word_vectors_meta(spark, d)
    return L.polarity_vocabulary(fx.polarity_lexicon(spark, d, wvm))


@register("lexicon_to_map", sql=W(
    "SELECT category, array_to_string(list(term ORDER BY pos), ' ') AS terms "
    "FROM category_lexicon GROUP BY category"))
def q_lexicon_to_map(spark, d):
    _, lex = _lex(spark, d)
    return L.lexicon_to_map(lex).select("category", F.array_join("terms", " ").alias("terms"))


@register("polarity_to_map", sql=W(
    "SELECT count(*) AS n_entries, round(sum(weight), 6) AS weight_sum FROM polarity_lexicon"))
def q_polarity_to_map(spark, d):
    wvm = fx.word_vectors_meta(spark, d)
    m = L.polarity_to_map(fx.polarity_lexicon(spark, d, wvm))
    return m.select(F.size("weights").cast("bigint").alias("n_entries"),
                    F.round(F.aggregate(F.map_values("weights"), F.lit(0.0),
                                        lambda a, x: a + x), 6).alias("weight_sum"))


@register("lexicon_shape", sql=W(
    "SELECT count(*) AS n_categories, max(n) AS max_rows, max(dim) AS dim FROM "
    "(SELECT l.category, count(*) AS n, max(len(w.vec)) AS dim FROM category_lexicon l "
    "LEFT JOIN word_vectors w ON w.word = l.term GROUP BY l.category)"))
def q_lexicon_shape(spark, d):
    wvm, lex = _lex(spark, d)
    return L.lexicon_shape(lex, wvm.select("word", "vec"))


@register("dedupe_last_weight", sql=W(
    "SELECT term, arg_max(weight, pos) AS weight, max(pos) AS pos FROM dup GROUP BY term",
    "dup AS (SELECT pos, term, weight FROM polarity_lexicon UNION ALL "
    f"SELECT pos + 1000000, term, -weight FROM polarity_lexicon WHERE {sql_hash_u('term')} % 3 = 0)"))
def q_dedupe_last_weight(spark, d):
    wvm = fx.word_vectors_meta(spark, d)
    pol = fx.polarity_lexicon(spark, d, wvm)
    dup = pol.unionByName(pol.where(hash_u("term") % 3 == 0)
                          .select((F.col("pos") + 1000000).alias("pos"), "term",
                                  (-F.col("weight")).alias("weight")))
    return L.dedupe_last_weight(dup).select("term", "weight", "pos")


# --- scalar functions on lexica -----------------------------------------------------

@register("split_key", sql=W(
    "SELECT category || ':' || term AS key, category, term FROM category_lexicon"))
def q_split_key(spark, d):
    _, lex = _lex(spark, d)
    keyed = lex.select(F.concat_ws(":", "category", "term").alias("key"))
    cat, term = T.split_key("key")
    return keyed.select("key", cat.alias("category"), term.alias("term"))


@register("pad_list", sql=W(
    "SELECT c.category, p.pos, l.term FROM (SELECT DISTINCT category FROM category_lexicon) c "
    "JOIN (SELECT DISTINCT pos FROM category_lexicon) p ON true "
    "LEFT JOIN category_lexicon l ON l.category = c.category AND l.pos = p.pos"))
def q_pad_list(spark, d):
    _, lex = _lex(spark, d)
    arrays = L.lexicon_to_map(lex)
    n = lex.agg(F.max("pos").alias("m")).first()["m"] + 1  # lexicon-sized scalar
    padded = arrays.select("category", pad_list("terms", n).alias("terms"))
    return padded.select("category", F.posexplode("terms").alias("pos", "term"))


@register("flatten_terms", sql=W("SELECT DISTINCT term FROM category_lexicon"))
def q_flatten_terms(spark, d):
    _, lex = _lex(spark, d)
    n = lex.agg(F.max("pos").alias("m")).first()["m"] + 1
    # the padded term matrix, one row per category
    matrix = L.lexicon_to_map(lex).select(pad_list("terms", n).alias("terms"))
    return V.flatten_terms(matrix, "terms")


@register("to_text", sql=(
    "SELECT conv_id, turn, CAST(turn AS VARCHAR) AS turn_text, CAST(text AS VARCHAR) AS text, "
    "length(CAST(text AS VARCHAR)) AS n_chars FROM conversations"))
def q_to_text(spark, d):
    """Numbers and whole texts as strings (F3); null stays null, an empty text empty."""
    c = fx.table(spark, d, "conversations")
    return c.select("conv_id", "turn", T.to_text("turn").alias("turn_text"), T.to_text("text").alias("text"),
                    F.length(T.to_text("text")).alias("n_chars"))


# --- vector joins ----------------------------------------------------------------------

_EMBED_SQL = """
lex2 AS (SELECT category, pos, term FROM category_lexicon UNION ALL
         SELECT 'bench', CAST(row_number() OVER (ORDER BY word) - 1 AS INTEGER), word FROM bench_words)
"""


@register("embed_lexicon", sql=W(
    "SELECT l.category, l.pos, l.term, w.vec IS NOT NULL AS has_vec, len(w.vec) AS dim, "
    "round(sqrt(list_sum(list_transform(w.vec, lambda x: x * x))), 6) AS vnorm "
    "FROM lex2 l LEFT JOIN word_vectors w ON w.word = l.term",
    SQL_BENCH_WORDS + ",\n" + _EMBED_SQL))
def q_embed_lexicon(spark, d):
    wvm, lex = _lex(spark, d)
    bench = global_row_number(_bench_words(spark, d), [F.col("word")], "pos").select(
        F.lit("bench").alias("category"), F.col("pos").cast("int"), F.col("word").alias("term"))
    emb = V.embed_lexicon(lex.unionByName(bench), wvm.select("word", "vec"))
    return emb.select("category", "pos", "term", F.col("vec").isNotNull().alias("has_vec"),
                      F.size("vec").alias("dim"), F.round(norm("vec"), 6).alias("vnorm"))


@register("filter_vectors", sql=W(
    "SELECT word, len(vec) AS dim, round(list_sum(vec), 6) AS vsum FROM word_vectors "
    "WHERE word IN (SELECT term FROM category_lexicon UNION SELECT word FROM bench_words)",
    SQL_BENCH_WORDS))
def q_filter_vectors(spark, d):
    wvm, lex = _lex(spark, d)
    terms = lex.select(F.col("term").alias("word")).unionByName(_bench_words(spark, d))
    out = V.filter_vectors(wvm.select("word", "vec"), terms)
    return out.select("word", F.size("vec").alias("dim"),
                      F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("vsum"))


@register("lookup_vectors", sql=W(
    "SELECT b.word, round(coalesce(list_sum(w.vec), 0.0), 6) AS vsum, "
    "coalesce(len(w.vec), (SELECT max(len(vec)) FROM word_vectors)) AS dim "
    "FROM bench_words b LEFT JOIN word_vectors w ON w.word = b.word", SQL_BENCH_WORDS))
def q_lookup_vectors(spark, d):
    wvm = fx.word_vectors_meta(spark, d)
    dim = wvm.agg(F.max(F.size("vec"))).first()[0]  # one scalar
    out = V.lookup_vectors(_bench_words(spark, d), wvm.select("word", "vec"), dim=dim,
                           missing="zero")
    return out.select("word", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6)
                      .alias("vsum"), F.size("vec").alias("dim"))
