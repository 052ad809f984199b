"""Persistence of fitted state as folders of parquet tables.

A saved model is a directory: one parquet table per fitted DataFrame plus
a one-row ``params`` table (JSON of the scalar settings).  No pickles, no
archives; every table is written and read by Spark, so the model can live
on the cluster's shared storage.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_tables(spark: SparkSession, path: str, tables: dict[str, DataFrame],
                params: dict | None = None) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(path, name))
    spark.createDataFrame([(json.dumps(params or {}, sort_keys=True),)], "params string") \
         .coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "params"))


def load_tables(spark: SparkSession, path: str, names: list[str]) -> tuple[dict, dict]:
    tables = {n: spark.read.parquet(os.path.join(path, n)) for n in names}
    row = spark.read.parquet(os.path.join(path, "params")).first()
    return tables, json.loads(row["params"])


# --- S7 / S10: word vectors ------------------------------------------------------------

def vectors_from_text(spark: SparkSession, path: str) -> DataFrame:
    """Public text vector format, one ``word v1 ... vD`` line per word; a
    file's first line with exactly two whole numbers (count, dim) is a header
    (S7).  All other lines are words, also those with one number."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    # a row for each file: the line at the start of its first block
    heads = lines.where("_start = 0").groupBy("_file").agg(F.min("_at").alias("_at")) \
        .select("_at", F.lit(True).alias("_head"))
    header = F.coalesce("_head", F.lit(False)) & F.trim("value").rlike(r"^\d+ \d+$")
    parts = lines.join(heads, "_at", "left").where(~header).select(F.split(F.trim("value"), " ").alias("p"))
    body = parts.where(F.size("p") >= 2)
    return body.select(F.element_at("p", 1).alias("word"),
                       F.transform(F.slice("p", 2, 1 << 30), lambda x: x.cast("double"))
                       .alias("vec"))


def write_vectors_text(word_vectors: DataFrame, path: str, header: bool = True) -> None:
    """Inverse of S7 (one output file per partition plus an optional header
    file named so that it sorts first)."""
    spark = word_vectors.sparkSession
    body = word_vectors.select(F.concat_ws(" ", "word", F.array_join(
        F.transform("vec", lambda x: x.cast("string")), " ")).alias("value"))
    body.write.mode("overwrite").text(path)
    if header:
        stats = word_vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
        spark.createDataFrame([(f"{stats['n']} {stats['d']}",)], "value string").coalesce(1) \
             .write.mode("append").text(path)


def save_vectors(word_vectors: DataFrame, path: str) -> None:
    """Vocabulary-restricted vectors as parquet."""
    word_vectors.select("word", "vec").write.mode("overwrite").parquet(path)


def load_vectors_filtered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("word", "vec")


# --- S11 / S12 / S13: fitted state ---------------------------------------------------------

def save_tfidf(spark: SparkSession, model, path: str) -> None:
    save_tables(spark, path, {"vocab": model.vocab, "pruned": model.pruned},
                {"n_docs": model.n_docs, "min_df": model.min_df, "max_df": model.max_df})


def load_tfidf(spark: SparkSession, path: str):
    from lexmesh.operators.tfidf import TfidfModel
    t, p = load_tables(spark, path, ["vocab", "pruned"])
    return TfidfModel(vocab=t["vocab"], n_docs=p["n_docs"], min_df=p["min_df"],
                      max_df=p["max_df"], pruned=t["pruned"])


def save_clusters(clusters: DataFrame, path: str) -> None:
    clusters.select("word", "cluster_id").write.mode("overwrite").parquet(path)


def load_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("word", "cluster_id")


def save_model(spark: SparkSession, path: str, models: DataFrame | None, params: dict,
               **tables: DataFrame) -> None:
    """Whole classifier / scaling model (S13).  Unlike the reference this
    also saves the trained members and main keys (Q1); an unfitted model
    (``models is None`` for a classifier) raises."""
    if params.get("kind") == "classifier" and models is None:
        raise ValueError("model is not fitted; nothing to save")
    if models is not None:
        tables = {**tables, "members": models}
    save_tables(spark, path, tables, params)


def load_model(spark: SparkSession, path: str, names: list[str]) -> tuple[dict, dict]:
    return load_tables(spark, path, names)
