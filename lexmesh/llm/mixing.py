"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each document's expected copies are ``target / size`` of its source.  Within a
source the documents stand in order of size; their expected copies are added
up to a prefix sum, one random offset is added for the source, and a document
is emitted once for each whole number its span crosses.  As the order is by
size, what is taken of a source is off its target by less than its longest
document, whatever the offset.

Prefix sums need no single task for a source: documents are counted by
(source, size, slice of the id's hash); sums over sizes and over at most 4096
slices place each slice, and only the rows of a slice are numbered together.

Defined results: a null text has size 0; a null source is one source, last in
order; null ids stand first in their slice; a source of size 0 has target 0 and
its documents are not taken; repeated rows count each.  An empty table gives an
empty result.  Other columns are not read by ``copies`` and are returned as
they are by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.llm.common import NO_ID, WORD, given, row_hash, text_or_empty, unused
from lexmesh.session import materialize

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix"
#: Hexadecimal digits of the id's hash that name a slice: 16 ** 3 slices.
SLICE_DIGITS = 3


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_key(source: Column) -> Column:
    """A string that is never null and differs between null and every text."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def sums_before(df: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """``df`` with the sum of each column ``sums[name]`` over all rows before a row,
    in ``order``, as ``name``: within ranges, plus the sums of the ranges before."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_part").agg(*(F.sum(col).alias(f"_{name}") for name, col in sums.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.select("_part", *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}")
                                      for name in sums))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumns({name: F.coalesce(F.sum(col).over(inside), F.lit(0)) for name, col in sums.items()})
    return rows.join(F.broadcast(totals), "_part").withColumns(
        {name: F.col(name) + F.col(f"_{name}") for name in sums}).drop("_part", *(f"_{name}" for name in sums))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``(key, source_size, target)`` from ``sizes(key, source, source_size)``, a
    row for each source.  Sources in order take the weights in turn.  Full
    sources stop at ``cap`` times their size: in order of ``cap size / weight``
    they are the first ones, and the rest share what those leave.  Sources may be
    as many as documents: they are numbered and added up in ranges."""
    rows = sums_before(sizes.withColumn("_one", F.lit(1)), [F.asc_nulls_last("source")], _turn="_one").drop("_one")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("_turn") % len(weights) + 1).cast("int")).cast("long")
    rows = rows.withColumn("w", w).withColumn("most", F.col("source_size") * cap)
    rows = rows.withColumn("_level", F.col("most") / F.col("w"))
    rows = sums_before(rows, [F.col("_level"), F.col("key")], full_before="most", w_before="w")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.sum("source_size").alias("_size"), F.sum("w").alias("_w"))))  # one row
    rows = rows.withColumn("level", (F.col("_size") - F.col("full_before")).cast("double")
                           / (F.col("_w") - F.col("w_before")).cast("double"))
    open_level = rows.agg(F.max(F.when(F.col("most") > F.col("level") * F.col("w"), F.col("level"))).alias("_open"))
    rows = rows.crossJoin(F.broadcast(open_level))
    return rows.select("key", "source_size", F.least(
        F.col("most").cast("double"), F.coalesce(F.col("_open") * F.col("w"), F.col("most").cast("double"))).alias("target"))


def copies(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``(doc_id, text_key, source, size, source_size, target, copies)``, a row for each row."""
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"),
                       "source", words(text).alias("size"))
    rows = rows.withColumns({
        "key": source_key(F.col("source")),
        "slice": F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, SLICE_DIGITS)})
    rows = materialize(rows, "sizes")

    slices = rows.groupBy("key", "source", "size", "slice").agg(F.count(F.lit(1)).alias("n"))
    slices = materialize(slices, "slices")
    classes = slices.groupBy("key", "source", "size").agg(F.sum("n").alias("n"))
    sizes = classes.groupBy("key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))

    def before(by, order):
        return F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))

    place = classes.select("key", "size", before(["key"], "size").alias("smaller"))
    place = place.join(targets(sizes, weights, cap), "key")
    slices = slices.select("key", "size", "slice", before(["key", "size"], "slice").alias("earlier")) \
        .join(place, ["key", "size"])

    by = ["key", "size", "slice"]
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("doc_id")))
    rank = (F.col("smaller") + F.col("earlier") + F.col("nth")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), "key")), 1, 4), 16, 10).cast("double") / 65536
    crossed = F.floor(offset + rate * rank) - F.floor(offset + rate * (rank - 1))
    return rows.withColumn("nth", nth).join(slices, by).select(
        "doc_id", "text_key", "source", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, all columns as given,
    whatever their names."""
    taken = copies(docs, weights, cap, seed)
    key, text, source, times, row = unused(docs, "_id", "_key", "_source", "_times", "_row")
    keys = [key, text, source]
    # repeated rows, in any order, meet by their number
    taken = taken.select(F.coalesce("doc_id", F.lit(NO_ID)).alias(key), F.col("text_key").alias(text),
                         source_key(F.col("source")).alias(source), F.col("copies").alias(times))
    taken = taken.withColumn(row, F.row_number().over(Window.partitionBy(*keys).orderBy(times))) \
        .where(F.col(times) > 0)
    rows = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
                             text: F.xxhash64(text_or_empty()), source: source_key(F.col("source"))})
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(row_hash(docs)))
    rows = rows.withColumn(row, number).join(taken, [*keys, row])
    return rows.select(*given(docs), F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(times)) \
        .drop(times)
