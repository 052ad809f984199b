"""Covariances as a mergeable aggregate, and principal components from them (M5).

Count, mean and centred products of any two sets of rows give those of both
exactly (Chan, Golub and LeVeque 1979), so tasks fold their rows into one triple
for each key, triples are merged in two levels, and no group of rows is ever
gathered.  A key costs ``dim ** 2`` numbers for each task, whatever its rows.
One eigen-decomposition of a ``dim x dim`` matrix for each key gives the
components; nothing of the size of the rows is decomposed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    centred: np.ndarray  # sum of (x - mean)(x - mean)^T

    @classmethod
    def of(cls, x: np.ndarray) -> "Moments":
        mean = x.mean(axis=0)
        away = x - mean
        return cls(len(x), mean, away.T @ away)

    def merged(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        apart = other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n),
                       self.centred + other.centred + np.outer(apart, apart) * (self.n * other.n / n))

    def covariance(self) -> np.ndarray:
        return self.centred / self.n


def principal(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` components of greatest variance as rows, and the variances.  Signs are
    fixed: a component's entry of greatest size is positive."""
    values, vectors = np.linalg.eigh(covariance)
    values, comps = values[::-1][:k], vectors[:, ::-1][:, :k].T
    largest = np.take_along_axis(comps, np.abs(comps).argmax(axis=1)[:, None], axis=1)
    return comps * np.where(largest < 0, -1.0, 1.0), np.maximum(values, 0.0)


def moments(rows: DataFrame, keys: Sequence[str], vec_col: str = "vec", spread: int | None = None) -> DataFrame:
    """``(*keys, n, mean, centred)`` of the non-null vectors of each key; ``centred`` is
    the matrix row by row.  ``spread`` is the number of first-level merges of a key."""
    keys = list(keys)
    kinds = [rows.schema[k] for k in keys]
    out = T.StructType([*kinds, T.StructField("part", T.LongType()), T.StructField("n", T.LongType()),
                        T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("centred", T.ArrayType(T.DoubleType()))])
    spread = spread or max(1, math.isqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    n_keys = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        part = 0
        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, n_keys + 1))) if n_keys else
                                    [()] * batch.num_rows):
                groups.setdefault(key, []).append(i)
            part = part or hash(batch.column(n_keys + 1)[0].as_py())
            vecs = batch.column(0).to_pylist()
            for key, at in groups.items():
                found = Moments.of(np.array([vecs[i] for i in at], float))
                held[key] = held[key].merged(found) if key in held else found
        if held:
            cols = [pa.array([k[i] for k in held], type=_arrow(kinds[i])) for i in range(n_keys)]
            some = list(held.values())
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([part % spread] * len(some), pa.int64()), pa.array([m.n for m in some], pa.int64()),
                 pa.array([m.mean for m in some], pa.list_(pa.float64())),
                 pa.array([m.centred.ravel() for m in some], pa.list_(pa.float64()))], [f.name for f in out.fields])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for n, mean, centred in zip(pdf["n"], pdf["mean"], pdf["centred"]):
            one = Moments(int(n), np.asarray(mean), np.asarray(centred).reshape(len(mean), -1))
            total = one if total is None else total.merged(one)
        first = pdf.iloc[:1][[*keys, "part"]].reset_index(drop=True)
        return first.assign(n=total.n, mean=[total.mean.tolist()], centred=[total.centred.ravel().tolist()])

    told = rows.where(F.col(vec_col).isNotNull()).select(
        F.col(vec_col).cast("array<double>").alias("vec"), *keys, F.spark_partition_id().cast("long").alias("task"))
    partial = told.mapInArrow(fold, out)
    once = partial.groupBy(*keys, "part").applyInPandas(merge, out)
    return once.withColumn("part", F.lit(0).cast("long")).groupBy(*keys, "part").applyInPandas(merge, out).drop("part")


def _arrow(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(field.dataType)


def covariances(rows: DataFrame, keys: Sequence[str], vec_col: str = "vec") -> DataFrame:
    """``(*keys, i, j, covariance)`` with ``i <= j``, over all rows of a key."""
    found = moments(rows, keys, vec_col)
    cells = found.select(*keys, "n", F.size("mean").alias("dim"), F.posexplode("centred").alias("at", "value"))
    i, j = F.floor(F.col("at") / F.col("dim")).cast("int"), (F.col("at") % F.col("dim")).cast("int")
    return cells.select(*keys, i.alias("i"), j.alias("j"), (F.col("value") / F.col("n")).alias("covariance")).where("i <= j")


def principal_components(rows: DataFrame, keys: Sequence[str], k: int, vec_col: str = "vec") -> DataFrame:
    """``(*keys, component, variance, vec)``: the ``k`` components of each key's rows."""
    keys = list(keys)
    kinds = [rows.schema[key] for key in keys]
    out = T.StructType([*kinds, T.StructField("component", T.IntegerType()), T.StructField("variance", T.DoubleType()),
                        T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def decompose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, r in pdf.iterrows():
                dim = len(r["mean"])
                comps, values = principal(np.asarray(r["centred"]).reshape(dim, dim) / r["n"], min(k, dim))
                yield pd.DataFrame({**{key: [r[key]] * len(comps) for key in keys}, "component": np.arange(len(comps)),
                                    "variance": values, "vec": [c.tolist() for c in comps]})

    return moments(rows, keys, vec_col).mapInPandas(decompose, out)
