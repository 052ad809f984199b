"""Corpus source (S8): any table with a document key and a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexmesh.operators.util import spread


def corpus_source(spark: SparkSession, path: str, id_col: str = "doc_id",
                  text_col: str = "text", fmt: str = "parquet") -> DataFrame:
    """Read ``(doc_id, text)``; the schema check replaces the reference's
    1-D shape check.  Under-partitioned inputs are spread on the key."""
    df = spark.read.format(fmt).load(path)
    return as_corpus(df, id_col, text_col)


def as_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    missing = [c for c in (id_col, text_col) if c not in df.columns]
    if missing:
        raise ValueError(f"corpus needs columns {id_col!r} and {text_col!r}; missing {missing}")
    out = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if not isinstance(out.schema["text"].dataType, StringType):
        out = out.withColumn("text", F.col("text").cast("string"))
    return spread(out, "doc_id")
