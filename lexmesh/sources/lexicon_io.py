"""Lexicon sources and sinks (S1-S5, S9, F8 export).

Every loader returns the long form ``(category string, pos int, term
string)`` or ``(pos int, term string, weight double)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmesh.operators.lexicon import LEXICON_SCHEMA, POLARITY_SCHEMA
from lexmesh.operators.util import global_row_number


def with_row_index(df: DataFrame, name: str = "pos") -> DataFrame:
    """0-based row index in read order (file order for a file source)."""
    ordered = df.withColumn("_mid", F.monotonically_increasing_id())
    return global_row_number(ordered, [F.col("_mid")], name=name).drop("_mid") \
        .withColumn(name, F.col(name).cast("int"))


def java_charset(encoding: str) -> str:
    import codecs
    name = codecs.lookup(encoding).name          # e.g. latin1 -> iso8859-1
    return {"iso8859-1": "iso-8859-1", "utf-8": "utf-8", "ascii": "us-ascii"}.get(name, name)


def lexicon_from_wide(wide: DataFrame, categories: Sequence[str] | None = None,
                      pos_col: str | None = None) -> DataFrame:
    """Wide table, one column per category (S1) -> long lexicon.  The row
    position becomes ``pos`` (``pos_col`` if given, else read order);
    missing cells are dropped (P2)."""
    if pos_col is None:
        wide = with_row_index(wide, "pos")
        pos_col = "pos"
    cats = list(categories) if categories else [c for c in wide.columns if c != pos_col]
    typed = wide.select(F.col(pos_col).cast("int").alias("pos"),
                        *[F.col(f"`{c}`").cast("string").alias(c) for c in cats])
    long = typed.unpivot(["pos"], cats, "category", "term")
    return long.where(F.col("term").isNotNull()).select("category", "pos", "term")


def lexicon_to_wide(lexicon: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Long lexicon -> wide ``(pos, <category>...)`` with null padding (F8's
    export form).  ``categories`` are the pivot values (lexicon keys)."""
    return (lexicon.groupBy("pos").pivot("category", list(categories)).agg(F.first("term"))
                   .select("pos", *categories))


def lexicon_from_dict(spark: SparkSession, mapping: Mapping[str, Sequence[str]]) -> DataFrame:
    """``{category: [terms]}`` (S2); ragged lists need no padding."""
    rows = [(cat, list(terms)) for cat, terms in mapping.items()]
    df = spark.createDataFrame(rows, "category string, terms array<string>")
    return lexicon_from_arrays(df)


def lexicon_from_arrays(df: DataFrame, cat_col: str = "category",
                        terms_col: str = "terms") -> DataFrame:
    """One row per category with an array of terms -> long lexicon."""
    return (df.select(F.col(cat_col).alias("category"),
                      F.posexplode(terms_col).alias("pos", "term"))
              .where(F.col("term").isNotNull())
              .select("category", F.col("pos").cast("int"), "term"))


def lexicon_from_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON file holding one object ``{category: [terms]}`` (S3)."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return lexicon_from_arrays(parsed.select(F.explode("m").alias("category", "terms")))


def write_lexicon_json(lexicon: DataFrame, path: str) -> None:
    """Write the lexicon as one JSON object (the inverse of S3).  A lexicon
    is small by nature, so one output file is written."""
    from lexmesh.operators.lexicon import lexicon_to_map
    m = lexicon_to_map(lexicon).agg(
        F.map_from_entries(F.collect_list(F.struct("category", "terms"))).alias("m"))
    m.select(F.to_json("m").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def lexicon_from_csv(spark: SparkSession, path: str, sep: str = ";",
                     encoding: str = "utf-8") -> DataFrame:
    """Any other path: a wide CSV with a header (S4), then S1.  Python
    encoding names (``latin1``) are mapped to Java charset names."""
    wide = spark.read.csv(path, header=True, sep=sep, encoding=java_charset(encoding))
    return lexicon_from_wide(wide)


def write_lexicon_csv(lexicon: DataFrame, path: str, categories: Sequence[str],
                      sep: str = ";", encoding: str = "utf-8") -> None:
    """Wide CSV in ``pos`` order, one file (inverse of S4)."""
    wide = lexicon_to_wide(lexicon, categories).orderBy("pos").drop("pos")
    wide.coalesce(1).write.mode("overwrite").csv(path, header=True, sep=sep,
                                                 encoding=java_charset(encoding))


def polarity_from_pairs(pairs, spark: SparkSession | None = None,
                        order_col: str | None = None) -> DataFrame:
    """Weighted lexicon from ``{word: weight}`` or a 2-column table (first
    column = word, second = weight) (S5).  ``pos`` keeps the input order."""
    if isinstance(pairs, Mapping):
        rows = [(i, str(k), float(v)) for i, (k, v) in enumerate(pairs.items())]
        return spark.createDataFrame(rows, POLARITY_SCHEMA)
    word_c, weight_c = [c for c in pairs.columns if c != order_col][:2]
    if order_col is None:
        pairs = with_row_index(pairs, "_pos")
        order_col = "_pos"
    return pairs.select(F.col(order_col).cast("int").alias("pos"),
                        F.col(word_c).cast("string").alias("term"),
                        F.col(weight_c).cast("double").alias("weight"))


def save_lexicon(lexicon: DataFrame, path: str, kind: str = "category") -> None:
    """Write a lexicon with its class tag."""
    lexicon.withColumn("kind", F.lit(kind)).write.mode("overwrite").parquet(path)


def load_lexicon(spark: SparkSession, path: str, kind: str = "category") -> DataFrame:
    """Read a saved lexicon; a wrong class tag raises ValueError.
    The tag check is a bounded action (one distinct value expected)."""
    df = spark.read.parquet(path)
    kinds = [r["kind"] for r in df.select("kind").distinct().limit(2).collect()]
    if kinds != [kind]:
        raise ValueError(f"expected a {kind!r} lexicon, found {kinds}")
    cols = ["category", "pos", "term"] if kind == "category" else ["pos", "term", "weight"]
    return df.select(*cols)


__all__ = ["LEXICON_SCHEMA", "POLARITY_SCHEMA", "lexicon_from_wide", "lexicon_to_wide",
           "lexicon_from_dict", "lexicon_from_arrays", "lexicon_from_json",
           "write_lexicon_json", "lexicon_from_csv", "write_lexicon_csv",
           "polarity_from_pairs", "save_lexicon", "load_lexicon", "with_row_index"]
