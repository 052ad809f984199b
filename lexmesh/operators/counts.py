"""Token counts written once, bucketed and sorted by document.

Counts per (document, word) feed vocabulary, tf-idf, ranks and document vectors.
Written as a table bucketed on the document key, they are read back with that
partitioning: sums, norms and top-n windows per document need no exchange, and
the text itself is read, cleaned and moved once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.functions.rules import DEFAULT_RULES
from lexmesh.operators.tokens import clean_docs, count_tokens, prepare_annotations, tokenize
from lexmesh.operators.util import in_place_join, spread, text_parts
from lexmesh.session import materialize, scratch_path, shuffles_dropped


def n_buckets(df: DataFrame, buckets: int | None = None) -> int:
    return buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def write_bucketed(df: DataFrame, name: str, key: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """``df`` as a table of ``buckets`` files (the shuffle partitions by default),
    bucketed and sorted on ``key``, below the shared checkpoint folder.  ``df``
    should come partitioned on ``key`` into that many partitions (``by_key``):
    then each task writes one file."""
    spark = df.sparkSession
    table = f"lexmesh_{name}_{uuid.uuid4().hex[:12]}"
    with shuffles_dropped(spark):
        df.write.bucketBy(n_buckets(df, buckets), key).sortBy(key).option("path", scratch_path(spark, name)) \
            .saveAsTable(table)
    return spark.table(table)


def by_key(df: DataFrame, key: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """One exchange to the partitions that the table's buckets have."""
    return df.repartition(n_buckets(df, buckets), key)


def text_buckets(docs: DataFrame, parts: int | None = None) -> int:
    """Buckets for the counts of ``docs``: the least multiple of the shuffle partitions that
    has a bucket for each of ``parts`` (:func:`text_parts`).  A task counts and sorts a bucket,
    so its memory has a bound whatever the corpus."""
    least, parts = n_buckets(docs), parts or text_parts(docs) or 1
    return least * -(-parts // least)


def surface_counts(docs: DataFrame, rules=DEFAULT_RULES, buckets: int | None = None,
                   parts: int | None = None) -> DataFrame:
    """``(doc_id, word, n)``: occurrences of each surface form (letter tokens as
    written) in the cleaned text, written bucketed by document.  Texts move
    to be cleaned and again to their buckets; tokens and counts stay in place."""
    corpus = docs.select("doc_id", "text")
    parts = parts or text_parts(corpus)
    buckets = buckets or text_buckets(corpus, parts or 1)
    # rules run in Python, after which Spark no longer knows that documents lie together: all
    # cores clean, and then texts, which are smaller than their counts, move to their buckets
    cleaned = clean_docs(spread(corpus, "doc_id", parts=parts), rules) if rules else corpus
    return write_bucketed(counts_in_place(cleaned, buckets), "surfaces", buckets=buckets)


def counts_in_place(cleaned: DataFrame, buckets: int | None = None) -> DataFrame:
    """``(doc_id, word, n)`` of cleaned texts, which move once; nothing moves after that."""
    return count_tokens(tokenize(by_key(cleaned, buckets=buckets), mode="letters", lower=False))


def term_counts(surfaces: DataFrame, annotations: DataFrame, stopwords: DataFrame, buckets: int | None = None,
                **analyzer) -> DataFrame:
    """``(doc_id, word, tf)`` of the analyzer (P7-P9, J6) from surface counts,
    written bucketed by document.  Surfaces without a word are in the mapping too, as null:
    rows of often ones then need not move to be dropped."""
    mapping = prepare_annotations(annotations, stopwords, **analyzer).withColumnRenamed("word", "norm")
    of = surfaces.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    mapping = materialize(of.join(mapping, of["word"] == mapping["surface"], "left").select("word", "norm", "df"), "mapping")
    joined = in_place_join(surfaces, mapping, "word", "df", buckets=n_buckets(surfaces, buckets)).where("norm IS NOT NULL")
    found = joined.select("doc_id", F.col("norm").alias("word"), "n").groupBy("doc_id", "word").agg(F.sum("n").alias("tf"))
    return write_bucketed(found, "tf", buckets=buckets)


def distinct_surfaces(surfaces: DataFrame) -> DataFrame:
    return surfaces.select(F.col("word").alias("surface")).distinct()
