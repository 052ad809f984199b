"""The kernel SVM's dual, solved exactly inside a bounded group (M4).

Sequential minimal optimisation with second-order working-set selection (Fan,
Chen and Lin 2005): of the points that may still move, one violates the
optimality condition most, its partner promises the greatest decrease, and the
pair's optimum is a closed form.  It ends when no pair violates the condition by
more than ``tol``, the duality gap's bound.  Kernel rows are computed when
wanted and kept in a cache of bounded bytes, so memory grows with the rows of a
group, not with their square.

Class weights scale each class's bound on its multipliers.  Probabilities come
from a sigmoid fitted to decision values of rows that were held out (Platt 1999
by cross-fitting), as in the usual kernel-SVM libraries.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

import numpy as np

TOL = 1e-3
CACHE_BYTES = 128 << 20


class Kernel:
    """Rows ``K(x_i, .)`` of ``rbf`` or ``linear`` over ``x``, cached."""

    def __init__(self, x: np.ndarray, kind: str = "rbf", gamma: float = 1.0, cache_bytes: int = CACHE_BYTES):
        if kind not in ("rbf", "linear"):
            raise ValueError(f"unknown kernel {kind!r}")
        self.x, self.kind, self.gamma = np.asarray(x, float), kind, gamma
        self.squares = np.einsum("ij,ij->i", self.x, self.x)
        self.diagonal = np.ones(len(self.x)) if kind == "rbf" else self.squares
        self.rows: OrderedDict[int, np.ndarray] = OrderedDict()
        self.most = max(2, cache_bytes // (8 * max(1, len(self.x))))

    def between(self, z: np.ndarray) -> np.ndarray:
        """``K(z_k, x_i)`` for given points."""
        z = np.asarray(z, float)
        dots = z @ self.x.T
        if self.kind == "linear":
            return dots
        apart = np.einsum("ij,ij->i", z, z)[:, None] + self.squares[None, :] - 2 * dots
        return np.exp(-self.gamma * np.maximum(apart, 0.0))

    def row(self, i: int) -> np.ndarray:
        found = self.rows.get(i)
        if found is None:
            found = self.between(self.x[i:i + 1])[0]
            self.rows[i] = found
            if len(self.rows) > self.most:
                self.rows.popitem(last=False)
        else:
            self.rows.move_to_end(i)
        return found


@dataclass
class Dual:
    """``alpha`` with ``0 <= alpha <= bound`` and ``sum(alpha * t) = 0``; ``gap`` is what
    the worst pair still violates the optimality condition by."""
    alpha: np.ndarray
    intercept: float
    gap: float
    steps: int


def solve(kernel: Kernel, inside: np.ndarray, bound: np.ndarray, tol: float = TOL, max_steps: int | None = None) -> Dual:
    """Maximise ``sum(alpha) - sum(alpha_i alpha_j t_i t_j K_ij) / 2`` for ``t = 1`` inside
    and ``-1`` outside.  ``bound`` is each row's greatest multiplier."""
    t = np.where(np.asarray(inside, bool), 1.0, -1.0)
    n = len(t)
    max_steps = max_steps or max(100_000, 200 * n)
    alpha, score = np.zeros(n), t.copy()  # score: t - sum_j alpha_j t_j K_j, the wish to move up
    up, low = t > 0, t < 0  # alpha * t may rise, may fall
    up, low = up & (bound > 0) | low & (alpha > 0), low & (bound > 0) | up & (alpha > 0)
    gap, steps = 0.0, 0
    while n:
        most = np.where(up, score, -np.inf)
        i = int(np.argmax(most))
        least = np.where(low, score, np.inf)
        gap = float(most[i] - least.min())
        if not gap > tol or steps >= max_steps:
            break
        row_i = kernel.row(i)
        drop = most[i] - least
        curve = np.maximum(kernel.diagonal[i] + kernel.diagonal - 2 * row_i, 1e-12)
        j = int(np.argmax(np.where(drop > 0, drop * drop / curve, -np.inf)))
        step = drop[j] / curve[j]
        step = min(step, bound[i] - alpha[i] if t[i] > 0 else alpha[i], alpha[j] if t[j] > 0 else bound[j] - alpha[j])
        for k, move in ((i, t[i] * step), (j, -t[j] * step)):
            alpha[k] = min(max(alpha[k] + move, 0.0), bound[k])
            if alpha[k] < 1e-12 * bound[k]:
                alpha[k] = 0.0
            elif alpha[k] > bound[k] * (1 - 1e-12):
                alpha[k] = bound[k]
            up[k] = alpha[k] < bound[k] if t[k] > 0 else alpha[k] > 0
            low[k] = alpha[k] > 0 if t[k] > 0 else alpha[k] < bound[k]
        score -= step * (row_i - kernel.row(j))
        steps += 1
    free = (alpha > 0) & (alpha < bound)
    if free.any():
        intercept = float(score[free].mean())
    else:  # between the last point that may rise and the first that may fall
        ends = [x for x in (np.max(score, where=up, initial=-np.inf), np.min(score, where=low, initial=np.inf))
                if np.isfinite(x)]
        intercept = float(np.mean(ends)) if ends else 0.0
    return Dual(alpha, intercept, max(gap, 0.0) if np.isfinite(gap) else 0.0, steps)


def bounds(inside: np.ndarray, svc_c: float) -> np.ndarray:
    """``svc_c`` times the balanced class weight ``n / (2 n_class)`` of each row."""
    inside = np.asarray(inside, bool)
    n_in = max(int(inside.sum()), 1)
    n_out = max(len(inside) - int(inside.sum()), 1)
    return svc_c * np.where(inside, len(inside) / (2.0 * n_in), len(inside) / (2.0 * n_out))


def folds_of(inside: np.ndarray, folds: int) -> np.ndarray:
    """Rows dealt in turn within their class, in the order they come."""
    inside = np.asarray(inside, bool)
    out = np.empty(len(inside), int)
    for part in (inside, ~inside):
        out[part] = np.arange(int(part.sum())) % folds
    return out


def held_out_values(x: np.ndarray, inside: np.ndarray, kind: str, gamma: float, svc_c: float, folds: int = 5,
                    tol: float = TOL) -> np.ndarray:
    """Decision value of each row from a machine fitted without its fold."""
    fold, out = folds_of(inside, folds), np.zeros(len(x))
    for f in range(folds):
        held = fold == f
        if not held.any():
            continue
        kernel = Kernel(x[~held], kind, gamma)
        found = solve(kernel, inside[~held], bounds(inside[~held], svc_c), tol)
        coef = found.alpha * np.where(inside[~held], 1.0, -1.0)
        out[held] = kernel.between(x[held]) @ coef + found.intercept
    return out
