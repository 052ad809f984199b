"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Stand-in for a null id where a join key must not be null.
NO_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Columns ``cols`` of a table folder or file (all columns without any)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name with as many underscores after it as it takes to differ from
    all columns of ``df`` (Spark ignores case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def given(df: DataFrame) -> list[Column]:
    """The columns of ``df`` as they are, whatever signs their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns, to order rows that are alike otherwise.  What holds
    a map is hashed as text."""
    return F.xxhash64(*(c.cast("string") if "map<" in f.dataType.simpleString() else c
                        for c, f in zip(given(df), df.schema.fields)))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a non-null Arrow string or binary column,
    without a copy of the texts."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def worker_cache(name: str, build):
    """A value kept for the life of this Python worker process (tokenizers,
    lookup caches).  Functions are pickled by value, so module globals would
    be rebuilt for each task; this dictionary is not."""
    kept = sys.__dict__.setdefault("_lexmesh_worker", {})
    if name not in kept:
        kept[name] = build()
    return kept[name]


def smallest_hashes(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """At most ``n`` rows, those with the smallest hashes of ``cols``.  Only rows
    below a hash that about ``4 * n`` rows are expected under are sorted, so
    what tasks send together doesn't grow with their number."""
    share = min(1.0, 4 * n / max(1, df.count()))
    by = F.xxhash64(*cols)
    return df.where(F.pmod(by, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(by, *cols).limit(n)
