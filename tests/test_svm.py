"""The dual solver against feasibility, optimality and plain quadratic programming."""

import numpy as np
import pytest

from lexmesh.operators import svm as S


def data(n=40, dim=3, seed=0, overlap=1.0, share=0.4):
    rng = np.random.default_rng(seed)
    inside = np.arange(n) < max(1, int(n * share))
    x = rng.normal(size=(n, dim)) * overlap + np.where(inside, 1.0, -1.0)[:, None]
    order = rng.permutation(n)
    return x[order], inside[order]


def project(v, t, bound):
    """The nearest point with 0 <= a <= bound and sum(a t) = 0, by bisection on the multiplier."""
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        total = (np.clip(v - mid * t, 0, bound) * t).sum()
        low, high = (mid, high) if total > 0 else (low, mid)
    return np.clip(v - (low + high) / 2 * t, 0, bound)


def quadratic_programme(k, t, bound, rounds=60_000):
    """Accelerated projected gradient on the dual, to the last digits."""
    q = k * np.outer(t, t)
    rate = 1 / np.linalg.eigvalsh(q).max()
    a = y = np.zeros(len(t))
    m = 1.0
    for _ in range(rounds):
        new = project(y - rate * (q @ y - 1), t, bound)
        m_new = (1 + np.sqrt(1 + 4 * m * m)) / 2
        y = new + (m - 1) / m_new * (new - a)
        if np.abs(new - a).max() < 1e-13:
            break
        a, m = new, m_new
    return a


@pytest.mark.parametrize("kind,svc_c,overlap,share", [("rbf", 1.0, 1.0, .4), ("rbf", 50.0, 2.0, .2), ("linear", 0.3, 1.5, .5),
                                                      ("rbf", 0.01, 1.0, .1)])
def test_decision_values_equal_quadratic_programming(kind, svc_c, overlap, share):
    x, inside = data(overlap=overlap, share=share)
    t, bound = np.where(inside, 1.0, -1.0), S.bounds(inside, svc_c)
    kernel = S.Kernel(x, kind, 0.4)
    got = S.solve(kernel, inside, bound, tol=1e-9, max_steps=10**6)
    k = kernel.between(x)
    want = quadratic_programme(k, t, bound)
    value = lambda a: a.sum() - (a * t) @ k @ (a * t) / 2
    assert abs(value(got.alpha) - value(want)) < 1e-6 * max(1, abs(value(want)))
    assert np.allclose(k @ (got.alpha * t), k @ (want * t), atol=1e-3 * max(1, svc_c) ** .5)


@pytest.mark.parametrize("seed", range(6))
def test_dual_feasibility_and_gap(seed):
    x, inside = data(n=150 + 40 * seed, dim=5, seed=seed, overlap=1 + seed / 3, share=.1 + .1 * seed)
    t, bound = np.where(inside, 1.0, -1.0), S.bounds(inside, [.1, 1, 10][seed % 3])
    kernel = S.Kernel(x, "rbf", 0.2, cache_bytes=1 << 14)  # a cache smaller than the matrix
    got = S.solve(kernel, inside, bound, tol=1e-3)
    assert (got.alpha >= 0).all() and (got.alpha <= bound).all() and abs((got.alpha * t).sum()) < 1e-9 * bound.sum()
    f = kernel.between(x) @ (got.alpha * t) + got.intercept
    assert got.gap <= 1e-3 and len(kernel.rows) <= kernel.most
    slack = 2e-3
    margin = t * f
    assert (margin[got.alpha == 0] >= 1 - slack).all() and (margin[got.alpha == bound] <= 1 + slack).all()
    free = (got.alpha > 0) & (got.alpha < bound)
    assert np.abs(margin[free] - 1).max(initial=0) <= slack


def test_one_class_repeats_and_no_rows():
    x = np.ones((6, 2))
    same = S.solve(S.Kernel(x), np.array([True] * 6), S.bounds(np.array([True] * 6), 1.0))
    assert (same.alpha == 0).all() and same.gap == 0 and same.intercept == 1
    both = np.array([True, True, False, False, True, False])
    tie = S.solve(S.Kernel(x), both, S.bounds(both, 1.0))
    assert np.allclose(S.Kernel(x).between(x) @ (tie.alpha * np.where(both, 1, -1)), 0)
    assert S.solve(S.Kernel(np.zeros((0, 2))), np.zeros(0, bool), np.zeros(0)).steps == 0


def test_held_out_values_leave_a_row_out():
    x, inside = data(60, seed=3)
    got = S.held_out_values(x, inside, "rbf", 0.4, 1.0, folds=4)
    fold = S.folds_of(inside, 4)
    assert all(abs(int((fold[inside] == f).sum()) - inside.sum() / 4) < 1 for f in range(4))
    for f in (0, 3):
        kernel = S.Kernel(x[fold != f], "rbf", 0.4)
        one = S.solve(kernel, inside[fold != f], S.bounds(inside[fold != f], 1.0))
        want = kernel.between(x[fold == f]) @ (one.alpha * np.where(inside[fold != f], 1, -1)) + one.intercept
        assert np.allclose(got[fold == f], want)
