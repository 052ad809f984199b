"""Small plan helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmesh.session import materialize

#: Bytes of a table that is sent to every executor to spare the larger side of a join its exchange.
SMALL_BYTES = 32 << 20
#: Bytes of text of a task that counts its tokens; counts in memory take some thirty times as much.
TASK_TEXT = 8 << 20


def global_row_number(df: DataFrame, order_cols: list, name: str = "idx",
                      start: int = 0) -> DataFrame:
    """Dense 0-based (or ``start``-based) row number over a total order.

    Distributed form of ``row_number() OVER (ORDER BY ...)``: range-partition
    on the order, number rows inside each range, then add the row count of
    all earlier ranges.  The ranged rows are written once with the number of
    their range, and both the numbering and the counts read that one table,
    so they agree on the ranges whatever columns either of them needs.  Only
    a table with one row per range is ordered globally.  ``order_cols`` must
    be a total order (break ties by a key).
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *order_cols)
                           .withColumn("_part", F.spark_partition_id()), "ranges")
    local = ranged.withColumn(
        "_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*order_cols)))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.select("_part", F.coalesce(F.sum("_cnt").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    # one row per range: n rows at most
    out = local.join(F.broadcast(offsets), "_part")
    return out.withColumn(name, (F.col("_off") + F.col("_rn") - 1 + start).cast("bigint")) \
              .drop("_part", "_rn", "_off")


def spread(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """Hash-partition the corpus once on the document key.

    Tokens exploded from it stay in the document's partition, so counts,
    norms and ranks per document need no further exchange, and a corpus
    stored in few row groups is read on all cores.  Without ``parts`` (see
    :func:`text_parts`) adaptive execution may join partitions up to its own
    target of bytes of text, which says little about the tokens."""
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


def text_parts(docs: DataFrame, text_col: str = "text", task_bytes: int | None = None) -> int | None:
    """Partitions that hold at most ``task_bytes`` (``TASK_TEXT``) of text each, on average, and
    at least one for each core; None if the whole text is no more than that."""
    task_bytes = task_bytes or TASK_TEXT
    held = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    if held <= task_bytes:
        return None
    return max(-(-held // task_bytes), docs.sparkSession.sparkContext.defaultParallelism)


def apart(df: DataFrame) -> DataFrame:
    """``df`` with columns of its own, to be grouped beside one it comes from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def sent_if_small(df: DataFrame, max_bytes: int = SMALL_BYTES) -> DataFrame:
    """``df``, a written table, marked for a broadcast if it :func:`is_small`; else as
    it is.  Spark's own limit goes by file sizes, and by exchanges that have then
    been made."""
    return F.broadcast(df) if is_small(df, max_bytes) else df


def in_place_join(rows: DataFrame, table: DataFrame, key: str, held: str, id_col: str = "doc_id",
                  buckets: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """``rows`` joined with ``table`` on ``key``, without moving most of them.

    ``rows`` lie by document, in ``buckets`` partitions; ``held`` says in how many documents a
    key of ``table``, which is written, is (any number that tells often keys from rare
    ones will do).  The keys in most documents, of ``max_bytes`` in all, are sent to the rows.  Only rows
    of the other keys, few for each key, move to them and back to their documents, so rows
    stay partitioned by document.  ``held`` is dropped."""
    max_bytes = max_bytes or SMALL_BYTES
    if is_small(table, max_bytes):
        return rows.join(F.broadcast(table.drop(held)), key)
    # sizes by powers of two: some 40 rows at most
    sizes = table.groupBy(F.floor(F.log2(F.greatest(F.col(held), F.lit(1)))).alias("level")).agg(
        F.sum(_row_bytes(table)).alias("size")).orderBy(F.desc("level")).collect()
    least = None
    for r in sizes:
        max_bytes -= r["size"]
        if max_bytes < 0:
            break
        least = r["level"]
    if least is None:
        return _back(rows.join(table.drop(held), key), id_col, buckets)
    often = F.coalesce(F.col(held), F.lit(0)) >= 2 ** least
    sent, rest = table.where(often).drop(held), table.where(~often).drop(held)
    moved = _matched(rows.join(F.broadcast(sent.select(key)), key, "left_anti"), rest, key)
    # in this order: Spark doesn't see the partitioning of a union that begins with a join
    return _back(moved, id_col, buckets).unionByName(_matched(rows, F.broadcast(sent), key))


def _matched(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join that keeps the partitioning of ``rows`` where ``table`` is sent.  An inner broadcast
    join names its keys twice, after which a union no longer knows that its sides are partitioned
    alike; an outer one doesn't, and stays one, as this condition is never folded."""
    met = F.when(F.spark_partition_id() >= 0, F.coalesce("_met", F.lit(False))).otherwise(F.lit(False))
    return rows.join(table.withColumn("_met", F.lit(True)), key, "left").where(met).drop("_met")


def _back(moved: DataFrame, id_col: str, buckets: int | None) -> DataFrame:
    return moved.repartition(buckets, id_col) if buckets else moved.repartition(id_col)


def _row_bytes(df: DataFrame):
    """Bytes of a row's values."""
    def size(f):
        if isinstance(f.dataType, T.StringType):
            return F.octet_length(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return 8 * F.size(f.name)
        return F.lit(8)

    return sum((F.coalesce(size(f), F.lit(0)) + 8 for f in df.schema.fields), F.lit(32))


def is_small(df: DataFrame, max_bytes: int = SMALL_BYTES) -> bool:
    """Whether the values of a written table, counted first, have at most ``max_bytes``."""
    return (df.agg(F.sum(_row_bytes(df))).first()[0] or 0) <= max_bytes
