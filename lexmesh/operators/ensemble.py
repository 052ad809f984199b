"""Ensemble fit and scoring.

Fit: every member of every category (and every parameter set / CV fold)
is one group of ``groupBy(category, param_id, fold, model_ix)
.applyInPandas``.  A member is: standardise -> optional PCA -> random
Fourier features for the RBF kernel (Rahimi & Recht 2007; identity map
for the linear kernel) -> class-balanced least-squares SVM in closed form
(Suykens & Vandewalle 1999) -> Platt sigmoid for probabilities.  With
``solver="dual"`` a member is the exact kernel SVM instead, its dual solved
by :mod:`lexmesh.operators.svm` and its sigmoid fitted to held-out values;
its row then holds the support vectors.  A group is the augmented training
set of one member.  It reaches its task as spans of numbered draws from the category's
training rows (:mod:`lexmesh.operators.draws`), and all sums over it are added up a block
of rows at a time, so neither its vectors nor its features are ever held whole.  Where a
class has more than ``parts.GROUP_ROWS`` labelled rows, the same sums are added up over parts
of a member's rows by all tasks (:mod:`lexmesh.operators.parts`); only the dual, which needs
all rows of a member at once, keeps to one group whatever its size.

Scoring (J9): ``mapInPandas`` over Arrow batches of vectors; the fitted
coefficient rows are broadcast in blocks of bounded bytes, and the member
probabilities are averaged inside the batch (A13), so scoring with one
block adds no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.operators import svm
from lexmesh.operators.covariance import Moments, principal
from lexmesh.operators.draws import Drawn, Rows, counted
from lexmesh.operators.util import apart

MODEL_SCHEMA = (
    "category string, param_id int, fold int, model_ix int, kernel string, "
    "mean array<double>, scale array<double>, components array<double>, n_comp int, "
    "rff_seed bigint, gamma double, n_rff int, coef array<double>, intercept double, "
    "platt_a double, platt_b double, n_rows int, n_inside int, solver string, "
    "support array<double>, gap double")
MEMBER_KEYS = ("category", "param_id", "fold", "model_ix")
ARRAYS = ("mean", "scale", "components", "coef", "support")

BLOCK_BYTES = 32 << 20   # coefficients that are broadcast at once
FEATURE_ROWS = 8192      # rows whose features are held at once when sums are added up
VALUE_COLUMNS = 16       # machines whose values of all rows are held at once

DEFAULT_PARAMS = {"kernel": "rbf", "svc_c": 1.0, "pca": None, "n_rff": 256, "solver": "fourier"}
SOLVERS = ("fourier", "dual")


def n_pca_components(pca, dim: int, n_rows: int) -> int:
    """Component count (M5): share < 1 -> int(dim * share); int -> min(n_rows,
    pca) - 1; None/False -> no PCA (0).  (``None`` means none here, Q21.)"""
    if pca is None or pca is False:
        return 0
    if isinstance(pca, float) and pca < 1:
        return max(1, int(dim * pca))
    return max(1, min(n_rows, int(pca)) - 1)


def _rff(z: np.ndarray, seed: int, gamma: float, n_rff: int) -> np.ndarray:
    rng = np.random.RandomState(seed % (2 ** 32))
    omega = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(z.shape[1], n_rff))
    phase = rng.uniform(0.0, 2.0 * math.pi, size=n_rff)
    return math.sqrt(2.0 / n_rff) * np.cos(z @ omega + phase)


def projected(x: np.ndarray, m: dict) -> np.ndarray:
    """Standardised and, with PCA, rotated rows."""
    z = (x - np.asarray(m["mean"])) / np.asarray(m["scale"])
    if m["n_comp"]:
        z = z @ np.asarray(m["components"]).reshape(m["n_comp"], -1).T
    return z


def _features(x: np.ndarray, m: dict) -> np.ndarray:
    z = projected(x, m)
    if m["kernel"] == "rbf":
        return _rff(z, int(m["rff_seed"]), float(m["gamma"]), int(m["n_rff"]))
    return z


def decision(x: np.ndarray, m: dict) -> np.ndarray:
    coef = np.asarray(m["coef"])
    if m["solver"] == "dual":
        if not len(coef):
            return np.full(len(x), float(m["intercept"]))
        support = np.asarray(m["support"]).reshape(len(coef), -1)
        kernel = svm.Kernel(support, m["kernel"], float(m["gamma"]))
        return kernel.between(projected(x, m)) @ coef + float(m["intercept"])
    return _features(x, m) @ coef + float(m["intercept"])


def member_proba(x: np.ndarray, m: dict) -> np.ndarray:
    f = decision(x, m)
    return 1.0 / (1.0 + np.exp(np.clip(m["platt_a"] * f + m["platt_b"], -500, 500)))


def _platt(f: np.ndarray, y: np.ndarray, iters: int = 50) -> tuple[float, float]:
    """Platt (1999) sigmoid fit with his target smoothing, Newton steps."""
    n_pos, n_neg = int(y.sum()), int((~y).sum())
    t = np.where(y, (n_pos + 1.0) / (n_pos + 2.0), 1.0 / (n_neg + 2.0))
    a, b = 0.0, math.log((n_neg + 1.0) / (n_pos + 1.0))
    for _ in range(iters):
        p = 1.0 / (1.0 + np.exp(np.clip(a * f + b, -500, 500)))
        g_a, g_b = np.sum((t - p) * f), np.sum(t - p)
        w = p * (1 - p)
        h_aa, h_ab, h_bb = np.sum(w * f * f) + 1e-12, np.sum(w * f), np.sum(w) + 1e-12
        det = h_aa * h_bb - h_ab * h_ab
        if abs(det) < 1e-18:
            break
        da = (h_bb * g_a - h_ab * g_b) / det
        db = (h_aa * g_b - h_ab * g_a) / det
        a, b = a - da, b - db
        if abs(da) < 1e-10 and abs(db) < 1e-10:
            break
    return float(a), float(b)


def _merged_spread(parts):
    """Number, mean and sum of squared deviations of all values, from those of parts."""
    n, mean, away = 0, 0.0, 0.0
    for n2, mean2, away2 in parts:
        apart = mean2 - mean if n else 0.0
        total = n + n2
        mean = mean + apart * (n2 / total) if n else mean2
        away = away + away2 + apart * apart * (n * n2 / total)
        n = total
    return n, mean, away


def _spread(x: np.ndarray, axis=None):
    mean = x.mean(axis=axis)
    return (x.size if axis is None else len(x)), mean, ((x - mean) ** 2).sum(axis=axis)


def prepared(rows: Rows | Drawn, pca, kernel: str, seed: int, n_rff: int) -> dict:
    """Standardisation, rotation and kernel width of a member."""
    n, mean, away = _merged_spread(_spread(x, axis=0) for _, x in rows.blocks(FEATURE_ROWS))
    d = len(mean)
    scale = np.sqrt(away / n)
    scale[scale == 0] = 1.0
    m = {"kernel": kernel, "mean": mean, "scale": scale, "components": np.zeros(0), "n_comp": 0,
         "rff_seed": int(seed), "n_rff": int(n_rff)}
    k = min(n_pca_components(pca, d, n), d)
    if k:
        total = None
        for _, x in rows.blocks(FEATURE_ROWS):
            found = Moments.of(projected(x, m))
            total = found if total is None else total.merged(found)
        comps, _ = principal(total.covariance(), k)
        m |= {"components": comps.ravel(), "n_comp": int(k)}
    size, _, away = _merged_spread(_spread(projected(x, m)) for _, x in rows.blocks(FEATURE_ROWS))
    return m | {"gamma": float(1.0 / (size // n * (away / size))) if away > 0 else 1.0}


def _whole(rows: Rows | Drawn, m: dict) -> np.ndarray:
    return np.concatenate([projected(x, m) for _, x in rows.blocks(FEATURE_ROWS)])


def balanced(n_pos: int, n_neg: int) -> tuple[float, float]:
    """``class_weight="balanced"`` (A16) inside and outside."""
    return (n_pos + n_neg) / (2.0 * max(n_pos, 1)), (n_pos + n_neg) / (2.0 * max(n_neg, 1))


def class_weights(y: np.ndarray) -> tuple[float, float]:
    return balanced(int(y.sum()), int((~y).sum()))


def ridge(gram: np.ndarray, moment: np.ndarray, svc_c: float) -> np.ndarray:
    """Least-squares machine from ``Σ w z zᵀ`` and ``Σ w z t``; the last entry, the
    intercept, is not penalised."""
    reg = np.eye(len(gram)) / float(svc_c)
    reg[-1, -1] = 1e-8
    return np.linalg.solve(gram + reg, moment)


def with_ones(phi: np.ndarray) -> np.ndarray:
    return np.hstack([phi, np.ones((len(phi), 1))])


def fit_member(x: np.ndarray | Rows | Drawn, y: np.ndarray, kernel: str = "rbf", svc_c: float = 1.0,
               pca=None, n_rff: int = 256, seed: int = 0, solver: str = "fourier") -> dict:
    """One member's coefficient row: closed form over Fourier features (X3), or
    the exact dual, which needs all its rows."""
    if solver not in SOLVERS:
        raise ValueError(f"unknown solver {solver!r}")
    rows = Rows(x) if isinstance(x, np.ndarray) else x
    m = prepared(rows, pca, kernel, seed, n_rff)
    m |= {"n_rows": len(rows), "n_inside": int(y.sum()), "solver": solver, "support": np.zeros(0), "gap": 0.0}
    if solver == "dual":
        z = _whole(rows, m)
        found = svm.solve(svm.Kernel(z, kernel, m["gamma"]), y, svm.bounds(y, svc_c))
        held = found.alpha > 0
        m |= {"coef": (found.alpha * np.where(y, 1.0, -1.0))[held], "support": z[held].ravel(),
              "intercept": found.intercept, "gap": found.gap}
        f = svm.held_out_values(z, y, kernel, m["gamma"], svc_c)
    else:
        w_in, w_out = class_weights(y)
        cw, t = np.where(y, w_in, w_out), np.where(y, 1.0, -1.0)
        gram = moment = 0.0
        for here, block in rows.blocks(FEATURE_ROWS):
            aug = with_ones(_features(block, m))
            gram = gram + aug.T @ (cw[here, None] * aug)
            moment = moment + aug.T @ (cw[here] * t[here])
        sol = ridge(gram, moment, svc_c)
        m |= {"coef": sol[:-1], "intercept": float(sol[-1])}
        f = np.concatenate([with_ones(_features(block, m)) @ sol for _, block in rows.blocks(FEATURE_ROWS)])
    m["platt_a"], m["platt_b"] = _platt(f, y)
    return m


def _rff_seed(seed: int, category: str, param_id: int, fold: int, model_ix: int) -> int:
    import hashlib
    key = f"{seed}|{category}|{param_id}|{fold}|{model_ix}|rff"
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16)


def _row(keys: dict, m: dict) -> dict:
    return keys | m | {k: np.asarray(m[k], dtype="float64").tolist() for k in ARRAYS}


MODEL_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(),
               "array<double>": pa.list_(pa.float64())}


def _model_table(found: list[dict]) -> pa.Table:
    fields = [c.split(" ") for c in MODEL_SCHEMA.split(", ")]
    return pa.Table.from_pylist(found, pa.schema([(n, MODEL_TYPES[t]) for n, t in fields]))


def _in_order(rows: pa.Table, *first: str) -> pa.Table:
    """Any order of arrival gives the same sums."""
    return rows.sort_by([(c, "ascending") for c in (*first, "inside", "kind", "sample_id")])


def _fitted(x: np.ndarray | Drawn, y: np.ndarray, keys: dict, params: dict[int, dict], seed: int) -> dict:
    p = {**DEFAULT_PARAMS, **params.get(keys["param_id"], {})}
    return _row(keys, fit_member(x, y, p["kernel"], float(p["svc_c"]), p["pca"], int(p["n_rff"]),
                                 _rff_seed(seed, *keys.values()), p["solver"]))


def _fit_groups_fn(params: dict[int, dict], seed: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        keys = {"category": first["category"], "param_id": int(first["param_id"]), "fold": int(first["fold"]),
                "model_ix": int(first["model_ix"])}
        x, y = np.vstack(pdf["vec"].to_numpy()), pdf["inside"].to_numpy().astype(bool)
        return pd.DataFrame([_fitted(x, y, keys, params, seed)])
    return fn


def _fit_drawn_fn(params: dict[int, dict], seed: int):
    def fn(key: tuple, rows: pa.Table, training: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _model_table([])
        keys = dict(zip(MEMBER_KEYS, (k.as_py() for k in key)))
        rows = _in_order(rows)
        y = counted(rows, "inside").astype(bool)
        return _model_table([_fitted(Drawn(rows, training), y, keys, params, seed)])
    return fn


def _keyed(df: DataFrame) -> DataFrame:
    """With parameter set and fold, if they are not there."""
    for c, none in (("param_id", 0), ("fold", -1)):
        df = df if c in df.columns else df.withColumn(c, F.lit(none))
    return df.withColumns({"param_id": F.col("param_id").cast("int"), "fold": F.col("fold").cast("int")})


def _as_drawn(rows: DataFrame, *cols: str) -> DataFrame:
    """The columns that the draws are made from: spans of rows, or a row for each draw."""
    made = ("n", "key", "n_in", "n_out", "n_by_src", "n_draw", "seed") if "key" in rows.columns else ("pool", "draws")
    return rows.select(*cols, *made)


def _for_members(training: DataFrame, n_models: int) -> DataFrame:
    """The training rows for each member that draws from them."""
    return apart(training.withColumn("model_ix", F.explode(F.sequence(F.lit(0), F.lit(n_models - 1)))))


def fit_ensemble(member_rows: DataFrame, params: dict[int, dict] | None = None, seed: int = 0,
                 training: DataFrame | None = None, n_models: int = 10) -> DataFrame:
    """Fit every member in one job (M4, M6): input rows have
    ``category, model_ix, inside, vec`` and optionally ``param_id, fold``.

    Rows with ``pool, draws`` instead of ``vec`` (``ensemble_training_set(...,
    vectors=False)``), or spans of them, need the ``training`` rows that they draw from, which
    are sent to each of the ``n_models`` members, or, for spans of large categories, read by
    the tasks that make a part of a member's vectors."""
    from lexmesh.operators.parts import Shape, is_large, members_by_parts
    rows, params = _keyed(member_rows).withColumn("model_ix", F.col("model_ix").cast("int")), params or {0: {}}
    if training is None:
        return rows.select(*MEMBER_KEYS, "inside", "vec").groupBy(*MEMBER_KEYS).applyInPandas(
            _fit_groups_fn(params, seed), schema=MODEL_SCHEMA)
    keys = [k for k in MEMBER_KEYS if k != "model_ix"]
    if "key" in rows.columns and is_large(_keyed(training), keys):
        dual = [int(pid) for pid, p in params.items() if p.get("solver") == "dual"]

        def shapes(unit: dict) -> list[Shape]:
            p = {**DEFAULT_PARAMS, **params.get(unit["param_id"], {})}
            return [Shape(p["kernel"], p["pca"], int(p["n_rff"]), _rff_seed(seed, *(unit[k] for k in MEMBER_KEYS)),
                          [(unit["param_id"], float(p["svc_c"]))])]

        found = members_by_parts(rows.where(~F.col("param_id").isin(dual)) if dual else rows, _keyed(training), keys,
                                 MEMBER_KEYS, shapes, False)
        if not dual:
            return found
        rows, training = (df.where(F.col("param_id").isin(dual)) for df in (rows, _keyed(training)))
        return found.unionByName(_fit_drawn(rows, params, seed, training, n_models))
    return _fit_drawn(rows, params, seed, training, n_models)


def _fit_drawn(rows: DataFrame, params: dict[int, dict], seed: int, training: DataFrame, n_models: int) -> DataFrame:
    pools = _for_members(_keyed(training), n_models).select(*MEMBER_KEYS, "row_id", "inside", "src_category", "vec")
    rows = _as_drawn(rows, *MEMBER_KEYS, "inside", "kind", "sample_id")
    return rows.groupBy(*MEMBER_KEYS).cogroup(pools.groupBy(*MEMBER_KEYS)).applyInArrow(
        _fit_drawn_fn(params, seed), schema=MODEL_SCHEMA)


def _shapes(params: dict[int, dict], ix: int, default_models: int) -> list[tuple[tuple, list[tuple[int, dict]]]]:
    """A member's parameter sets by what their features are made with."""
    shapes: dict[tuple, list[tuple[int, dict]]] = {}
    for pid, given in params.items():
        p = {**DEFAULT_PARAMS, **given}
        if ix < int(p.get("n_models", default_models)):
            shapes.setdefault((p["kernel"], p["pca"], int(p["n_rff"]), p["solver"]), []).append((int(pid), p))
    return sorted(shapes.items(), key=lambda s: s[1][0][0])


def _fold_models(x: np.ndarray | Drawn, y: np.ndarray, fold: np.ndarray, category: str, ix: int,
                 params: dict[int, dict], seed: int, default_models: int) -> list[dict]:
    """Machines of every parameter set and fold of one member from sums by fold."""
    rows = Rows(x) if isinstance(x, np.ndarray) else x
    out = []
    for (kernel, pca, n_rff, solver), sets in _shapes(params, ix, default_models):
        m = prepared(rows, pca, kernel, _rff_seed(seed, category, sets[0][0], -1, ix), n_rff)
        for f, pid, fitted, values in (_by_sums if solver == "fourier" else _by_dual)(m, rows, y, fold, sets):
            rest = fold != f
            a, b = _platt(values, y[rest])
            out.append(_row({"category": category, "param_id": pid, "fold": int(f), "model_ix": ix},
                            m | fitted | {"platt_a": a, "platt_b": b, "n_rows": int(rest.sum()),
                                          "n_inside": int(y[rest].sum()), "solver": solver}))
    return out


def _fold_models_fn(params: dict[int, dict], seed: int, default_models: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fold", "inside", "kind", "sample_id"])  # any order of arrival gives the same sums
        out = _fold_models(np.vstack(pdf["vec"].to_numpy()), pdf["inside"].to_numpy().astype(bool), pdf["fold"].to_numpy(),
                           pdf["category"].iloc[0], int(pdf["model_ix"].iloc[0]), params, seed, default_models)
        return pd.DataFrame(out, columns=[c.split()[0] for c in MODEL_SCHEMA.split(", ")])
    return fn


def _fold_drawn_fn(params: dict[int, dict], seed: int, default_models: int):
    def fn(key: tuple, rows: pa.Table, training: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _model_table([])
        category, ix = (k.as_py() for k in key)
        rows = _in_order(rows, "fold")
        return _model_table(_fold_models(Drawn(rows, training, ("fold",)), counted(rows, "inside").astype(bool),
                                         counted(rows, "fold"), category, ix, params, seed, default_models))
    return fn


def _by_sums(m: dict, rows: Rows | Drawn, y: np.ndarray, fold: np.ndarray, sets):
    """``Σ z zᵀ`` and ``Σ z`` are added up once for each fold and class.  The training
    sums of a fold are the totals less its own, weighted by class, whatever
    ``svc_c``.  Features are made a block of rows at a time."""
    def blocks():
        for here, x in rows.blocks(FEATURE_ROWS):
            yield here, with_ones(_features(x, m))

    keys = [(f, c) for f in np.unique(fold) for c in (True, False)]
    gram, moment = dict.fromkeys(keys, 0.0), dict.fromkeys(keys, 0.0)
    for here, aug in blocks():
        for f, c in keys:
            part = aug[(fold[here] == f) & (y[here] == c)]
            gram[f, c] = gram[f, c] + part.T @ part
            moment[f, c] = moment[f, c] + part.sum(axis=0)
    found = []
    for f in np.unique(fold):
        g = r = 0.0
        for c, weight in zip((True, False), class_weights(y[fold != f])):
            g = g + weight * (sum(gram[k] for k in keys if k[1] == c) - gram[f, c])
            r = r + (weight if c else -weight) * (sum(moment[k] for k in keys if k[1] == c) - moment[f, c])
        found += [(f, pid, ridge(g, r, float(p["svc_c"]))) for pid, p in sets]
    for k in range(0, len(found), VALUE_COLUMNS):
        some = found[k:k + VALUE_COLUMNS]
        every = np.stack([sol for *_, sol in some], axis=1)
        values = np.concatenate([aug @ every for _, aug in blocks()])
        for j, (f, pid, sol) in enumerate(some):
            yield f, pid, {"coef": sol[:-1], "intercept": float(sol[-1]), "support": np.zeros(0), "gap": 0.0}, \
                values[fold != f, j]


def _by_dual(m: dict, rows: Rows | Drawn, y: np.ndarray, fold: np.ndarray, sets):
    """The exact machine has no sums to share: each fold and set is solved."""
    z = _whole(rows, m)
    for f in np.unique(fold):
        rest = fold != f
        for pid, p in sets:
            c = float(p["svc_c"])
            found = svm.solve(svm.Kernel(z[rest], m["kernel"], m["gamma"]), y[rest], svm.bounds(y[rest], c))
            held = found.alpha > 0
            yield f, pid, {"coef": (found.alpha * np.where(y[rest], 1.0, -1.0))[held], "support": z[rest][held].ravel(),
                           "intercept": found.intercept, "gap": found.gap}, \
                svm.held_out_values(z[rest], y[rest], m["kernel"], m["gamma"], c)


def fit_folds(fold_rows: DataFrame, params: dict[int, dict], seed: int = 0, n_models: int = 10,
              training: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Members for every parameter set and held-out fold from one read of a
    member's rows (M11, M12): ``fold_rows`` has ``category, model_ix, fold, inside,
    kind, sample_id, vec``, each augmented row once, in the fold whose rows it
    combines.  A machine of fold f is fitted on the rows of all other folds.
    Standardisation, rotation and kernel width come from the member's rows of
    all folds (they hold no labels), so sums over features can be shared.

    Rows with ``pool, draws`` instead of ``vec``, or spans of them, need the ``training`` rows, with
    their ``fold``, for each of ``most`` members, as in :func:`fit_ensemble`."""
    from lexmesh.operators.parts import Shape, is_large, members_by_parts
    rows = fold_rows.withColumns({"model_ix": F.col("model_ix").cast("int"), "fold": F.col("fold").cast("int")})
    by, cols = ["category", "model_ix"], ["category", "model_ix", "fold", "inside", "kind", "sample_id"]
    if training is None:
        return rows.select(*cols, "vec").groupBy(*by).applyInPandas(
            _fold_models_fn(params, seed, n_models), schema=MODEL_SCHEMA)
    training = training.withColumn("fold", F.col("fold").cast("int"))
    if "key" in rows.columns and is_large(training, ["category"]):
        dual = {pid: p for pid, p in params.items() if p.get("solver") == "dual"}

        def shapes(unit: dict) -> list[Shape]:
            return [Shape(kernel, pca, n_rff, _rff_seed(seed, unit["category"], sets[0][0], -1, unit["model_ix"]),
                          [(pid, float(p["svc_c"])) for pid, p in sets])
                    for (kernel, pca, n_rff, solver), sets in _shapes(params, unit["model_ix"], n_models) if solver != "dual"]

        found = members_by_parts(rows, training, ["category", "fold"], by, shapes, True)
        return found.unionByName(_fold_drawn(rows, dual, seed, n_models, training, most)) if dual else found
    return _fold_drawn(rows, params, seed, n_models, training, most)


def _fold_drawn(rows: DataFrame, params: dict[int, dict], seed: int, n_models: int, training: DataFrame,
                most: int | None) -> DataFrame:
    by, cols = ["category", "model_ix"], ["category", "model_ix", "fold", "inside", "kind", "sample_id"]
    pools = _for_members(training, most or n_models).select(*by, "fold", "row_id", "inside", "src_category", "vec")
    return _as_drawn(rows, *cols).groupBy(*by).cogroup(pools.groupBy(*by)).applyInArrow(
        _fold_drawn_fn(params, seed, n_models), schema=MODEL_SCHEMA)


def _member_scores(x: np.ndarray, m: dict, run_fast: bool) -> np.ndarray:
    return (decision(x, m) > 0).astype("float64") if run_fast else member_proba(x, m)   # hard vote (M13)


def _score_fn(block, id_cols: Sequence[str], level: str, run_fast: bool):
    def fn(batches):
        models = block.value              # shipped once per executor (broadcast)
        sets = sorted({(m["category"], m["param_id"], m["fold"]) for m in models})
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.vstack(pdf["vec"].to_numpy())
            out = [(m, _member_scores(x, m, run_fast)) for m in models]
            if level == "member":
                for m, p in out:
                    yield pdf[list(id_cols)].assign(category=m["category"], param_id=m["param_id"],
                                                    fold=m["fold"], model_ix=m["model_ix"], proba=p)
            else:
                for key in sets:
                    ps = [p for m, p in out if (m["category"], m["param_id"], m["fold"]) == key]
                    yield pdf[list(id_cols)].assign(category=key[0], param_id=key[1], fold=key[2],
                                                    total=np.sum(ps, axis=0), members=len(ps))
    return fn


def model_blocks(models: DataFrame, max_bytes: int = BLOCK_BYTES):
    """The fitted coefficient rows in blocks of about ``max_bytes``, so that
    what is broadcast at once has a bound however many members there are."""
    block, held = [], 0
    for r in models.orderBy("category", "param_id", "fold", "model_ix").toLocalIterator():
        m = r.asDict()
        size = 8 * sum(len(m[k]) for k in ARRAYS)
        if block and held + size > max_bytes:
            yield block
            block, held = [], 0
        block.append(m)
        held += size
    if block:
        yield block


def predict_proba(vectors: DataFrame, models: DataFrame, id_cols: Sequence[str] = ("id",),
                  vec_col: str = "vec", level: str = "category", run_fast: bool = False,
                  max_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Probability per category for given vectors (M7, J9): long
    ``(*ids, category, proba)``; ``level="member"`` keeps every member
    (``param_id, fold, model_ix``) for A13 / M13.

    Models are broadcast in blocks of at most ``max_bytes``.  One block, the
    usual case, needs no shuffle; several give sums per block that are added
    up per id."""
    idf = vectors.select(*id_cols, F.col(vec_col).alias("vec")).where(F.col("vec").isNotNull())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in idf.schema.fields
                       if f.name in id_cols)
    schema = f"{fields}, category string, param_id int, fold int, " + (
        "model_ix int, proba double" if level == "member" else "total double, members int")
    sc = vectors.sparkSession.sparkContext
    parts = [idf.mapInPandas(_score_fn(sc.broadcast(b), id_cols, level, run_fast), schema=schema)
             for b in model_blocks(models, max_bytes)]
    if not parts:
        parts = [vectors.sparkSession.createDataFrame([], schema)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if level == "member":
        return out
    if len(parts) > 1:
        out = out.groupBy(*id_cols, "category", "param_id", "fold").agg(
            F.sum("total").alias("total"), F.sum("members").alias("members"))
    one_set = models.select("param_id", "fold").distinct().limit(2).count() <= 1
    out = out.withColumn("proba", F.col("total") / F.col("members"))
    if one_set:
        return out.select(*id_cols, "category", "proba")
    return out.groupBy(*id_cols, "category").agg(F.avg("proba").alias("proba"))


def score_held_out(held: DataFrame, models: DataFrame) -> DataFrame:
    """Members' scores of held-out rows: ``(category, param_id, fold, model_ix,
    id, inside, proba)``.  Rows ``held(category, fold, id, inside, vec)``, and ``param_id`` if
    they are for one set only, meet the members of their own category, fold and parameter
    set only, by a cogroup; neither side passes the driver.  The rows of a large group are
    dealt to several, which the members are sent to, so none has many more than
    ``parts.GROUP_ROWS``."""
    from lexmesh.operators.parts import GROUP_ROWS
    keys = [k for k in ("category", "fold", "param_id") if k in held.columns]
    most = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    n_parts = -(-most // GROUP_ROWS)
    if n_parts > 1:
        held = held.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n_parts)).cast("int"))
        models = models.withColumn("part", F.explode(F.array(*[F.lit(k) for k in range(n_parts)])))
        keys.append("part")

    def fn(rows: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        frames = []
        if len(rows) and len(members):
            x = np.vstack(rows["vec"].to_numpy())
            for m in members.to_dict("records"):
                frames.append(rows[["category", "fold", "id", "inside"]].assign(
                    param_id=m["param_id"], model_ix=m["model_ix"], proba=member_proba(x, m)))
        cols = ["category", "param_id", "fold", "model_ix", "id", "inside", "proba"]
        return pd.concat(frames)[cols] if frames else pd.DataFrame(columns=cols)

    return held.groupBy(*keys).cogroup(models.groupBy(*keys)).applyInPandas(
        fn, "category string, param_id int, fold int, model_ix int, id bigint, inside boolean, proba double")


def ensemble_mean_proba(member_proba_df: DataFrame, id_cols: Sequence[str] = ("id",)) -> DataFrame:
    """Mean of member probabilities, then mean over parameter sets."""
    per_param = member_proba_df.groupBy(*id_cols, "category", "param_id") \
                               .agg(F.avg("proba").alias("proba"))
    return per_param.groupBy(*id_cols, "category").agg(F.avg("proba").alias("proba"))


def hard_vote(member_votes: DataFrame, id_cols: Sequence[str] = ("id",)) -> DataFrame:
    """Mean of hard 0/1 member votes (M13, ``run_fast``)."""
    return ensemble_mean_proba(member_votes, id_cols)


def class_balance_weights(training: DataFrame) -> DataFrame:
    """``class_weight="balanced"``: n / (2 · n_class) per category and class
    (A16), as a weight column for every training row.  Classes are counted
    with partial aggregates; the rows join those counts, two per category."""
    counts = training.groupBy("category", "inside").agg(F.count(F.lit(1)).alias("_n_class"))
    totals = counts.groupBy("category").agg(F.sum("_n_class").alias("_n"))
    weights = counts.join(totals, "category").select(
        "category", "inside", (F.col("_n") / (F.lit(2.0) * F.col("_n_class"))).alias("class_weight"))
    return training.join(weights, ["category", "inside"])
