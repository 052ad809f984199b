"""Corpus pipeline: five dealt operators in turn, each on all documents its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the
columns of ``documents``.  ``run`` writes what a stage returns to the shared
checkpoint folder and reads it again as the next one's input, so no stage is
computed twice and a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmesh.llm.exact_dedup import drop_duplicates
from lexmesh.llm.langid import keep_identified
from lexmesh.llm.mixing import mix
from lexmesh.llm.packing import pack, pieces
from lexmesh.llm.simhash import drop_near_duplicates
from lexmesh.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a sufficient margin."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_duplicates(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 3 or fewer differing fingerprint bits."""
    return drop_near_duplicates(docs, words=3, max_bits=3)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return pack(pieces(docs))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Compression classes, SimHash and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name)
    return docs
