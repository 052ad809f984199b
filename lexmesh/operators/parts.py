"""Members of large categories, fitted from parts of their rows.

A category whose classes have more labelled rows than ``GROUP_ROWS`` is too large for
the tasks that fit a member in one group.  Its members' augmented rows are dealt to
parts of ``PART_ROWS`` numbers instead.  The category's training rows are written once, in the
order in which draws name them, and a task reads them a batch at a time while it makes the
vectors of a part, so it holds a part and a batch, whatever the category's size.  Nothing
but spans of numbers and sums moves between tasks.

A member takes three reads of its rows: count, mean and centred products, which give
standardisation, rotation and kernel width; ``Σ z zᵀ`` and ``Σ z`` of the features by
fold and class, which give the machines; and the machines' values, to which the
sigmoids are fitted (eight bytes a row and machine meet in one task).  All of them are the sums
that :mod:`lexmesh.operators.ensemble` adds up within a group; no row is left out.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmesh.operators.covariance import Moments, principal
from lexmesh.operators.draws import BLOCK_ROWS, matrix, plain, span_draws
from lexmesh.operators.ensemble import (FEATURE_ROWS, MODEL_SCHEMA, VALUE_COLUMNS, _features, _model_table, _row, balanced,
                                        n_pca_components, ridge, with_ones)
from lexmesh.session import materialize, scratch_path, shuffles_dropped
from lexmesh.sources.binary_vectors import _open

GROUP_ROWS = 20_000     # labelled rows of a class up to which a member's rows are made and fitted in one task
PART_ROWS = 1 << 16     # rows of a member whose vectors are made together
READ_ROWS = 1 << 14     # training rows that are read at once
SPAN_COLS = ("sample_id", "n", "key", "n_in", "n_out", "n_by_src", "n_draw", "seed")


# --- training rows as draws name them -------------------------------------------------

def written_pools(training: DataFrame, keys: Sequence[str]) -> str:
    """Folder with the training rows: ``place`` is a row's number in its class by ``row_id``,
    and ``at`` the one by source category first, so the rows of a source are consecutive."""
    cls = Window.partitionBy(*keys, "inside")
    rows = training.select(*keys, "inside", "row_id", "vec",
                           (F.row_number().over(cls.orderBy("row_id")) - 1).cast("bigint").alias("place"),
                           (F.row_number().over(cls.orderBy(F.asc_nulls_first("src_category"), "row_id")) - 1)
                           .cast("bigint").alias("at"))
    path = scratch_path(training.sparkSession, "pools")
    with shuffles_dropped(training.sparkSession):
        rows.write.option("parquet.block.size", 8 << 20).parquet(path)
    return path


def pool_batches(path: str, where: dict, address: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(address, row_id, vec)`` of the training rows with the given keys and class, a batch at a time."""
    import pyarrow.dataset as ds
    system, at = _open(path)
    told = None
    for name, value in where.items():
        one = ds.field(name) == value
        told = one if told is None else told & one
    found = ds.dataset(at, filesystem=system, format="parquet").to_batches(
        columns=[address, "row_id", "vec"], filter=told, batch_size=READ_ROWS, use_threads=False,
        batch_readahead=1, fragment_readahead=1)
    for batch in found:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            yield plain(rows.column(address)), plain(rows.column("row_id")), matrix(rows.column("vec"))


def part_vectors(path: str, where: dict, kind: str, spans: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the rows of a part's spans in their order, and the ``row_id`` of each one's first draw."""
    inside, sample = where["inside"], kind == "sample"
    places, weights = [], []
    for span in spans:
        pool, place, weight = span_draws(span | {"inside": inside, "kind": kind})
        if sample and not inside:  # the rows of a source begin after those of the sources before
            place = place + np.cumsum([0, *span["n_by_src"]])[pool][:, None]
        places.append(place if sample else place[:, :1])
        weights.append(weight if sample else weight[:, :1])
    place, weight = np.concatenate(places), np.concatenate(weights).astype("float64")
    weight /= weight.sum(axis=1, keepdims=True)
    orders = [np.argsort(place[:, k], kind="stable") for k in range(place.shape[1])]
    named = [place[order, k] for k, order in enumerate(orders)]
    out, ids, met = None, np.zeros(len(place), np.int64), 0
    for address, row_ids, vecs in pool_batches(path, where, "at" if sample else "place"):
        if out is None:
            out = np.zeros((len(place), vecs.shape[1]))
        for k, order in enumerate(orders):
            first, last = (np.searchsorted(named[k], address, side) for side in ("left", "right"))
            times = last - first
            here = np.repeat(np.arange(len(address)), times)
            rows = order[np.arange(len(here)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)]
            out[rows] += weight[rows, k, None] * vecs[here]
            met += len(rows)
            if not k:
                ids[rows] = row_ids[here]
    if out is None or met != place.size:
        raise ValueError(f"{met} of {place.size} drawn training rows found")
    return out, ids


def is_large(training: DataFrame, keys: Sequence[str]) -> bool:
    """Whether a class of a key has more labelled rows than one task should hold."""
    counts = training.groupBy(*keys, "inside").agg(F.count(F.lit(1)).alias("n"))
    return (counts.agg(F.max("n")).first()[0] or 0) > GROUP_ROWS


def dealt(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(*by, inside, kind, part, spans)``: spans of at most ``PART_ROWS`` rows of a key together, written."""
    part = F.floor(F.col("sample_id") / PART_ROWS).cast("int").alias("part")
    rows = spans.groupBy(*by, "inside", "kind", part).agg(
        F.sort_array(F.collect_list(F.struct(*SPAN_COLS))).alias("spans"))
    return materialize(rows, "parts")


def _tasks(parts: DataFrame) -> DataFrame:
    """Parts are few bytes and much work: they are dealt in turn to all tasks."""
    return parts.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _each(rows: DataFrame, fn: Callable[[dict], Iterator], schema) -> DataFrame:
    """``fn`` of each row as a dict, which gives tables of ``schema``."""
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                for found in fn(batch.slice(k, 1).to_pylist()[0]):
                    yield from found.to_batches()
    return rows.mapInArrow(run, schema)


def vectors_by_parts(spans: DataFrame, training: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that ``spans`` stand for: ``(*keys, model_ix, inside, kind, sample_id, vec)``."""
    path, keys, block = written_pools(training, keys), list(keys), BLOCK_ROWS
    parts = dealt(spans, [*keys, "model_ix"])
    out = T.StructType([*(f for f in spans.schema.fields if f.name in (*keys, "model_ix", "inside", "kind", "sample_id")),
                        T.StructField("vec", T.ArrayType(T.DoubleType()))])
    names = [f.name for f in out.fields]
    types = {f.name: f.type for f in _arrow(out)}

    def fn(r):
        x, ids = part_vectors(path, {k: r[k] for k in (*keys, "inside")}, r["kind"], r["spans"])
        if not (r["inside"] and r["kind"] == "original"):  # an inside original is known by its row's id
            ids = np.concatenate([np.arange(s["sample_id"], s["sample_id"] + s["n"]) for s in r["spans"]])
        for k in range(0, len(x), block):
            some, dim = x[k:k + block], x.shape[1]
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dim), pa.array(some.ravel()))
            own = {"sample_id": pa.array(ids[k:k + block]), "vec": vec}
            yield pa.table([own[n] if n in own else pa.array([r[n]] * len(some), types[n]) for n in names], names=names)

    return _each(_tasks(parts), fn, out)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


# --- machines from sums of parts ----------------------------------------------------------

@dataclass
class Shape:
    """Machines that share their features: ``sets`` are the parameter sets and their ``svc_c``."""
    kernel: str
    pca: float | int | None
    n_rff: int
    seed: int
    sets: list[tuple[int, float]]


def shaped(total: Moments, shape: Shape) -> dict:
    """Standardisation, rotation and kernel width, as :func:`lexmesh.operators.ensemble.prepared`
    has them, from the moments of all rows."""
    d, cov = len(total.mean), total.covariance()
    scale = np.sqrt(np.diag(cov))
    scale[scale == 0] = 1.0
    cov = cov / np.outer(scale, scale)
    m = {"kernel": shape.kernel, "mean": total.mean, "scale": scale, "components": np.zeros(0), "n_comp": 0,
         "rff_seed": int(shape.seed), "n_rff": int(shape.n_rff)}
    k = min(n_pca_components(shape.pca, d, total.n), d)
    if k:
        comps, _ = principal(cov, k)
        m |= {"components": comps.ravel(), "n_comp": int(k)}
        cov = comps @ cov @ comps.T
    # all columns have mean 0, so the variance of all entries is the mean of the columns' variances
    away = float(np.trace(cov))
    return m | {"gamma": 1.0 / away if away > 0 else 1.0}


def sigmoid(values: list[tuple[np.ndarray, bool]], iters: int = 50) -> tuple[float, float]:
    """:func:`lexmesh.operators.ensemble._platt` of values that are given by parts of one class."""
    n = {c: sum(len(f) for f, y in values if y == c) for c in (True, False)}
    target = {True: (n[True] + 1.0) / (n[True] + 2.0), False: 1.0 / (n[False] + 2.0)}
    a, b = 0.0, math.log((n[False] + 1.0) / (n[True] + 1.0))
    for _ in range(iters):
        g_a = g_b = h_aa = h_ab = h_bb = 0.0
        for f, y in values:
            p = 1.0 / (1.0 + np.exp(np.clip(a * f + b, -500, 500)))
            w, away = p * (1 - p), target[y] - p
            g_a, g_b = g_a + np.sum(away * f), g_b + np.sum(away)
            h_aa, h_ab, h_bb = h_aa + np.sum(w * f * f), h_ab + np.sum(w * f), h_bb + np.sum(w)
        h_aa, h_bb = h_aa + 1e-12, h_bb + 1e-12
        det = h_aa * h_bb - h_ab * h_ab
        if abs(det) < 1e-18:
            break
        da, db = (h_bb * g_a - h_ab * g_b) / det, (h_aa * g_b - h_ab * g_a) / det
        a, b = a - da, b - db
        if abs(da) < 1e-10 and abs(db) < 1e-10:
            break
    return float(a), float(b)


def members_by_parts(spans: DataFrame, training: DataFrame, pool_keys: Sequence[str], unit: Sequence[str],
                     shapes_of: Callable[[dict], list[Shape]], held_out: bool) -> DataFrame:
    """Members' rows (``ensemble.MODEL_SCHEMA``) of every ``unit``, whose rows are standardised
    together, and each of its shapes and parameter sets; with ``held_out`` one for each
    fold, fitted on the others, else one of all rows."""
    path, pool_keys, unit = written_pools(training, pool_keys), list(pool_keys), list(unit)
    by = list(dict.fromkeys([*unit, "fold"]))
    parts = dealt(spans, by)
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    unit_ddl = ", ".join(f"{c} {kinds[c]}" for c in unit)
    extra = "" if "fold" in unit else "fold int, "
    told = f"{unit_ddl}, {extra}inside boolean, kind string, part int"

    def vectors(r):
        return part_vectors(path, {k: r[k] for k in (*pool_keys, "inside")}, r["kind"], r["spans"])[0]

    def row(r, schema, **more):
        return pa.Table.from_pylist([r | more], schema)

    def ordered(pdf):
        """Any order of arrival gives the same sums."""
        return pdf.sort_values(["fold", "inside", "kind", "part"])

    def blocks(x):
        for k in range(0, len(x), FEATURE_ROWS):
            yield x[k:k + FEATURE_ROWS]

    # 1: moments
    def moments(r):
        total = None
        for x in blocks(vectors(r)):
            one = Moments.of(x)
            total = one if total is None else total.merged(one)
        yield row(r, moments_arrow, found=pickle.dumps((total.n, total.mean, total.centred)))

    def prepare(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for found in ordered(pdf)["found"]:
            one = Moments(*pickle.loads(found))
            total = one if total is None else total.merged(one)
        key = _key(pdf, unit)
        return pd.DataFrame([key | {"prepared": pickle.dumps([shaped(total, s) for s in shapes_of(key)])}])

    moments_ddl = f"{told}, found binary"
    moments_arrow = _arrow(T.StructType.fromDDL(moments_ddl))
    prepared = materialize(_each(_tasks(parts), moments, moments_ddl).groupBy(*unit).applyInPandas(
        prepare, f"{unit_ddl}, prepared binary"), "prepared")

    # 2: sums of features by fold and class
    def sums(r):
        x = vectors(r)
        for j, m in enumerate(pickle.loads(r["prepared"])):
            gram = moment = 0.0
            for some in blocks(x):
                aug = with_ones(_features(some, m))
                gram, moment = gram + aug.T @ aug, moment + aug.sum(axis=0)
            yield row(r, sums_arrow, shape=j, n=len(x), found=pickle.dumps((gram, moment)))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        total: dict[tuple, list] = {}
        for fold, inside, n, found in ordered(pdf)[["fold", "inside", "n", "found"]].itertuples(index=False):
            gram, moment = pickle.loads(found)
            held = total.setdefault((int(fold), bool(inside)), [0, 0.0, 0.0])
            held[:] = held[0] + int(n), held[1] + gram, held[2] + moment
        key, j = _key(pdf, unit), int(pdf["shape"].iloc[0])
        machines = []
        for f in sorted({f for f, _ in total}) if held_out else [None]:
            n = {c: sum(v[0] for (g, d), v in total.items() if d == c and g != f) for c in (True, False)}
            gram = moment = 0.0
            for c, weight in zip((True, False), balanced(n[True], n[False])):
                rest = [v for (g, d), v in total.items() if d == c and g != f]
                gram = gram + weight * sum((v[1] for v in rest), 0.0)
                moment = moment + (weight if c else -weight) * sum((v[2] for v in rest), 0.0)
            machines += [{"fold": f, "param_id": pid, "sol": ridge(gram, moment, c), "n_rows": n[True] + n[False],
                          "n_inside": n[True]} for pid, c in shapes_of(key)[j].sets]
        return pd.DataFrame([key | {"shape": j, "machines": pickle.dumps(machines)}])

    sums_ddl = f"{told}, shape int, n bigint, found binary"
    sums_arrow = _arrow(T.StructType.fromDDL(sums_ddl))
    solved = materialize(_each(_tasks(parts.join(prepared, unit)), sums, sums_ddl).groupBy(*unit, "shape").applyInPandas(
        solve, f"{unit_ddl}, shape int, machines binary"), "solved")
    solutions = solved.groupBy(*unit).agg(F.sort_array(F.collect_list(F.struct("shape", "machines"))).alias("solved"))
    states = materialize(prepared.join(solutions, unit), "states")

    # 3: values, and the sigmoid of each machine
    def values(r):
        x = vectors(r)
        features = pickle.loads(r["prepared"])
        for s in r["solved"]:
            m, machines = features[s["shape"]], pickle.loads(s["machines"])
            mine = [(k, one) for k, one in enumerate(machines) if one["fold"] is None or one["fold"] != r["fold"]]
            for at in range(0, len(mine), VALUE_COLUMNS):
                some = mine[at:at + VALUE_COLUMNS]
                every = np.stack([one["sol"] for _, one in some], axis=1)
                found = np.concatenate([with_ones(_features(b, m)) @ every for b in blocks(x)])
                for i, (k, _) in enumerate(some):
                    yield row(r, values_arrow, shape=s["shape"], machine=k, found=found[:, i].tobytes())

    def platt(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [(np.frombuffer(v), bool(c)) for v, c in ordered(pdf)[["found", "inside"]].itertuples(index=False)]
        a, b = sigmoid(found)
        return pd.DataFrame([_key(pdf, [*unit, "shape", "machine"]) | {"a": a, "b": b}])

    def members(r):
        m = pickle.loads(r["prepared"])[r["shape"]]
        one = pickle.loads({s["shape"]: s["machines"] for s in r["solved"]}[r["shape"]])[r["machine"]]
        keys = {"category": r["category"], "param_id": one["param_id"],
                "fold": r["fold"] if one["fold"] is None else one["fold"], "model_ix": r["model_ix"]}
        yield _model_table([_row(keys, m | {
            "coef": one["sol"][:-1], "intercept": float(one["sol"][-1]), "support": np.zeros(0), "gap": 0.0,
            "platt_a": r["a"], "platt_b": r["b"], "n_rows": one["n_rows"], "n_inside": one["n_inside"], "solver": "fourier"})])

    values_ddl = f"{told}, shape int, machine int, found binary"
    values_arrow = _arrow(T.StructType.fromDDL(values_ddl))
    sigmoids = _each(_tasks(parts.join(states, unit)), values, values_ddl).groupBy(*unit, "shape", "machine").applyInPandas(
        platt, f"{unit_ddl}, shape int, machine int, a double, b double")
    # written: the last join would otherwise wait for, or repeat, the values
    return _each(materialize(sigmoids, "sigmoids").join(states, unit), members, MODEL_SCHEMA)


def _key(pdf: pd.DataFrame, names: Sequence[str]) -> dict:
    first = pdf.iloc[0]
    return {n: first[n] if isinstance(first[n], str) else int(first[n]) for n in names}
