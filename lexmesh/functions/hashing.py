"""Reproducible hash draws.

``u`` is the first 8 hex digits of ``md5(concat_ws('|', parts))`` read as an
unsigned integer.  The same expression exists in DuckDB
(``('0x' || substr(md5(...), 1, 8))::BIGINT``), so every random choice made
with it can be checked by an oracle and is identical when a task is retried.
Never ``rand()`` in a plan that may be recomputed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_u(*parts) -> Column:
    """``parts``: Columns, column names (str) or literal numbers."""
    cols = []
    for p in parts:
        if isinstance(p, Column):
            cols.append(p.cast("string"))
        elif isinstance(p, str):
            cols.append(F.col(p).cast("string"))
        else:
            cols.append(F.lit(str(p)))
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("bigint")


def sql_hash_u(*parts: str) -> str:
    """DuckDB form of :func:`hash_u`; ``parts`` are SQL expressions."""
    inner = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"('0x' || substr(md5(concat_ws('|', {inner})), 1, 8))::BIGINT"


def hash_slices(n: int, *parts) -> list[Column]:
    """``n`` (<= 4) independent 32-bit draws from ONE md5: the i-th draw is
    hex digits ``8i+1 .. 8i+8`` of ``md5(concat_ws('|', parts))``."""
    if not 1 <= n <= 4:
        raise ValueError("one md5 gives at most four 32-bit draws")
    cols = []
    for p in parts:
        if isinstance(p, Column):
            cols.append(p.cast("string"))
        elif isinstance(p, str):
            cols.append(F.col(p).cast("string"))
        else:
            cols.append(F.lit(str(p)))
    h = F.md5(F.concat_ws("|", *cols))
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(n)]


def sql_hash_slice(i: int, *parts: str) -> str:
    inner = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"('0x' || substr(md5(concat_ws('|', {inner})), {8 * i + 1}, 8))::BIGINT"
