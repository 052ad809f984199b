"""Array-of-double vector expressions (all JVM-side higher-order functions).

Vectors are ``array<double>`` columns so that results stay SQL-friendly; only
the few places that use Spark ML aggregates convert them to ML vectors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """Dot product of two equal-length arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, v: acc + v)


def norm(a) -> Column:
    """Euclidean norm."""
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, v: acc + v * v))


def unit(a) -> Column:
    """``a / ||a||``; a zero vector stays a zero vector."""
    a = _c(a)
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda v: v * 0.0)).otherwise(
        F.transform(a, lambda v: v / n))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either vector has norm 0."""
    a, b = _c(a), _c(b)
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def scale(a, s) -> Column:
    s = _c(s) if not isinstance(s, (int, float)) else F.lit(float(s))
    return F.transform(_c(a), lambda v: v * s)


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def literal_vector(values: Sequence[float]) -> Column:
    """A driver-side, dim-sized vector as a literal array column."""
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def dot_literal(a, values: Sequence[float]) -> Column:
    return dot(a, literal_vector(values))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim).cast("array<double>")


def pad_list(a, n: int, fill=None, element_type: str = "string") -> Column:
    """Pad with ``fill`` (null by default) or cut an array to length ``n`` (F8)."""
    filler = F.array_repeat(F.lit(fill).cast(element_type), n)
    return F.slice(F.concat(_c(a), filler), 1, n)


def linear_combination(vectors, weights) -> Column:
    """Σ wᵢ·vᵢ for an array of vectors and an array of weights.

    The weights are used as given; callers normalise them to sum 1.
    """
    vectors, weights = _c(vectors), _c(weights)
    first = F.element_at(vectors, 1)
    zero = F.transform(first, lambda v: v * 0.0)
    pairs = F.arrays_zip(vectors.alias("v"), weights.alias("w"))
    return F.aggregate(pairs, zero,
                       lambda acc, p: F.zip_with(acc, p["v"], lambda x, y: x + p["w"] * y))


def _convex_batch(w, vv):
    """Arrow batch body of :func:`convex_combination` (numpy, vectorised)."""
    import numpy as np
    import pandas as pd
    weights = np.vstack(w.to_numpy()).astype("float64")               # (n, k)
    weights /= weights.sum(axis=1, keepdims=True)
    vecs = np.stack([np.vstack(x) for x in vv.to_numpy()])             # (n, k, d)
    return pd.Series(list(np.einsum("nk,nkd->nd", weights, vecs)))


def convex_combination(weights, vectors) -> Column:
    """Σ (wᵢ / Σw)·vᵢ per row for an array of weights and an array of
    vectors, as an Arrow-batched pandas UDF: Spark's lambda functions are
    interpreted per element, which dominates when every row carries a few
    high-dimensional vectors (augmentation)."""
    udf = F.pandas_udf(_convex_batch, "array<double>")
    return udf(_c(weights), _c(vectors))
