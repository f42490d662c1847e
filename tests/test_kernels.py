"""Solvers: optimality conditions, documented values, and errors."""

import warnings

import numpy as np
import pytest

from sparsonde.operators import kernels, stability
from sparsonde.operators.lbfgs import LBFGS, AllZeroLBFGSError, LBFGSError, fmin_lbfgs
from sparsonde.plans.decomposition import check_ranks, column_select, leverage, rank_list, right_singular_vectors

rng = np.random.default_rng(0)
X = rng.standard_normal((300, 6))


@pytest.mark.parametrize("ratio", [1.0, 0.4])
def test_descent_meets_the_kkt_conditions(ratio):
    y = X @ np.array([2, -1, 0, 0, 0.3, 0]) + 0.1 * rng.standard_normal(300)
    g, c = X.T @ X / 300, X.T @ y / 300
    for lam in (0.01, 0.2, 1.0, 3.0):
        b = kernels.descent(g, c, lam, ratio, tol=1e-12)
        grad = c - g @ b - lam * (1 - ratio) * b
        assert np.all(np.abs(grad[b == 0]) <= lam * ratio + 1e-8)
        assert np.allclose(grad[b != 0], lam * ratio * np.sign(b[b != 0]), atol=1e-7)


def test_path_starts_at_zero_and_grows():
    y = X @ np.array([2.0, -1, 0, 0, 0, 0])
    g, c = X.T @ X / 300, X.T @ y / 300
    top = np.abs(c).max()
    b = kernels.path(g, c, [(top * 1.001, 1.0), (top * 0.99, 1.0), (top * 1e-4, 1.0)])
    assert not b[0].any() and b[1].any() and set(np.flatnonzero(b[2])) >= {0, 1}


def test_least_squares_of_a_singular_matrix_has_the_smallest_norm():
    x = np.column_stack([X[:, 0], X[:, 0]])
    assert np.allclose(kernels.least_squares(x.T @ x, x.T @ (4 * X[:, 0])), [2, 2])


@pytest.mark.parametrize("loss", ["logistic", "multinomial", "poisson"])
def test_gradients(loss):
    y = rng.integers(0, 3, 300)
    w = rng.standard_normal(21 if loss == "multinomial" else 7) * 0.3
    weight = rng.random(300)
    f = {
        "logistic": lambda v: kernels.logistic_loss(v, X, np.where(y > 0, 1, -1), 0.3, weight=weight),
        "multinomial": lambda v: tuple(np.ravel(a) if i else a for i, a in enumerate(kernels.multinomial_loss(v.reshape(7, 3), X, np.eye(3)[y], 0.3, weight=weight))),
        "poisson": lambda v: kernels.poisson_loss(v, X, y, 0.3, weight),
    }[loss]
    grad = f(w)[1]
    for j in range(len(w)):
        e = np.zeros(len(w))
        e[j] = 1e-6
        assert (f(w + e)[0] - f(w - e)[0]) / 2e-6 == pytest.approx(grad[j], abs=1e-6)


@pytest.mark.parametrize("solver", ["lbfgs", "cd"])
def test_poisson_solvers(solver):
    y = rng.poisson(np.exp(0.5 * X[:, 0] - 0.4 * X[:, 2] + 0.3))
    b, b0 = kernels.fit_poisson(X, y, 0.05, 0.8, solver=solver, tol=1e-7)
    grad = -kernels.poisson_loss(np.r_[b, b0], X, y)[1]
    assert abs(grad[-1]) < 1e-3
    pull = grad[:-1] - 0.05 * 0.2 * b
    assert np.all(np.abs(pull[b == 0]) <= 0.04 + 1e-3) and np.allclose(pull[b != 0], 0.04 * np.sign(b[b != 0]), atol=1e-3)
    assert kernels.fit_poisson(X, np.zeros(300))[1] == -np.inf and kernels.fit_poisson(X, np.ones(300))[1] == 0
    with pytest.raises(ValueError):
        kernels.fit_poisson(X, y, solver="newton")


def test_logistic_fits():
    y = (rng.random(300) < kernels.sigmoid(X[:, 0] * 2 - X[:, 1])).astype(int)
    coef, b = kernels.fit_logistic(X, y, 2, "l2", np.inf, tol=1e-8)
    value, grad = kernels.logistic_loss(np.r_[coef[0], b], X, np.where(y == 1, 1.0, -1.0))
    assert np.abs(grad).max() < 1e-6
    three = np.argmax(X[:, :3] + rng.standard_normal((300, 3)) * 0.5, axis=1)
    mask = np.eye(3, 6, dtype=bool)
    coef, b = kernels.fit_logistic(X, three, 3, "l2", np.inf, mask=mask, tol=1e-6)
    assert not coef[~mask].any() and (coef[mask] > 0).all()
    tiled, _ = kernels.fit_logistic(np.tile(X, (3, 1)), np.tile(three, 3), 3, "l2", np.inf, mask=mask, tol=1e-6)
    assert np.allclose(coef - coef.mean(), tiled - tiled.mean(), atol=1e-2)
    top = np.abs(X.T @ (y - y.mean()) / 300).max()
    assert not kernels.fit_logistic(X, y, 2, "l1", 1 / (top * 1.01), tol=1e-8)[0].any()
    assert kernels.fit_logistic(X, y, 2, "l1", 1 / (top * 0.9), tol=1e-8)[0].any()


def test_path_equals_single_fits():
    y = rng.integers(0, 3, 300)
    cs = [0.5, 5.0, 50.0]
    coefs, intercepts = kernels.logistic_path(X, y, 3, cs, tol=1e-7)
    for c, coef, b in zip(cs, coefs, intercepts, strict=True):
        alone, b0 = kernels.fit_logistic(X, y, 3, "l1", c, tol=1e-7)
        assert np.allclose(coef, alone, atol=1e-3) and np.allclose(b - b.mean(), b0 - b0.mean(), atol=1e-3)


def test_intercepts_at_fixed_coefficients():
    y = rng.integers(0, 3, 300)
    eta = rng.standard_normal((300, 3))
    b = kernels.intercept_of_logistic(eta, y)
    assert np.allclose(kernels.softmax(eta + b).mean(axis=0), np.bincount(y) / 300, atol=1e-6) and b.max() == 0
    one = kernels.intercept_of_logistic(eta[:, :1], (y > 0).astype(int))
    assert kernels.sigmoid(eta[:, 0] + one[0]).mean() == pytest.approx((y > 0).mean(), abs=1e-8)


def test_minimiser():
    def square(x, g, at=1.0):
        g[...] = 2 * (x - at)
        return ((x - at) ** 2).sum()

    def quartic(x, g):
        g[...] = 2 * (x[0] - 0.1), 4 * (x[1] - 9) ** 3
        return (x[0] - 0.1) ** 2 + (x[1] - 9) ** 4

    assert np.allclose(fmin_lbfgs(square, np.zeros((2, 2)), args=(3.0,)), 3)
    assert np.allclose(fmin_lbfgs(square, [5.0, -5.0], line_search="armijo"), 1, atol=1e-4)
    assert np.allclose(fmin_lbfgs(square, [0.0, 0.0], orthantwise_c=1.0, orthantwise_end=1), [0.5, 1.0], atol=1e-4)
    assert not fmin_lbfgs(square, [4.0, 4.0], orthantwise_c=3.0).any()
    seen = []
    fmin_lbfgs(square, [9.0], progress=lambda *a: seen.append(a[6]) or None)
    assert seen == list(range(1, len(seen) + 1)) and seen
    with pytest.raises(TypeError):
        fmin_lbfgs(3, [0.0])
    with pytest.raises(TypeError):
        fmin_lbfgs(square, [0.0], progress=4)
    with pytest.raises(LBFGSError):
        fmin_lbfgs(square, [0.0], m=0)
    with pytest.raises(AllZeroLBFGSError):
        LBFGS(orthantwise_c=1.9, orthantwise_end=1, stop_at_zero=True).minimize(quartic, np.array([0.4, 3.0]))
    with warnings.catch_warnings(record=True) as got:
        warnings.simplefilter("always")
        fmin_lbfgs(lambda x, g: (g.__setitem__(0, 4 * x[0] ** 3), x[0] ** 4 + 1)[1], [3.0], max_iterations=1)
    assert any("limit" in str(w.message) for w in got)


def test_thresholds():
    assert stability.thresholds(0.5, 48) == [24] and stability.thresholds([0.1, 1.0], 48) == [4, 48] and stability.thresholds([3, 40], 48) == [3, 40]
    for bad in (0, 49, 1.1, [1, 0.5], "x", [], True):
        with pytest.raises(ValueError):
            stability.thresholds(bad, 48)
    with pytest.raises(ValueError):
        stability.threshold([1, 2], 48)


def test_non_negative_least_squares():
    for _ in range(20):
        a = rng.standard_normal((30, 5))
        x = rng.standard_normal(30)
        w = kernels.nnls(a.T @ a, a.T @ x)
        grad = a.T @ (x - a @ w)
        assert (w >= 0).all() and (grad[w == 0] <= 1e-7).all() and np.allclose(grad[w > 0], 0, atol=1e-7)


def test_factorisation_and_clusters():
    x = np.abs(rng.standard_normal((40, 3))) @ np.abs(rng.standard_normal((3, 12)))
    w, h = kernels.nmf(x, 3, 1, max_iter=2000, tol=1e-9)
    assert (w >= 0).all() and (h >= 0).all() and np.abs(x - w @ h).max() < 0.3
    assert kernels.dissimilarity(h, h[::-1] * 3) == pytest.approx(0, abs=1e-9)
    points = np.array([[0.0], [0.1], [0.2], [5.0], [5.1], [9.0]])
    assert kernels.dbscan(points, 0.3, 2).tolist() == [0, 0, 0, 1, 1, -1]


def test_columns():
    v = right_singular_vectors(X.T @ X, 3)
    assert np.allclose(v.T @ v, np.eye(3)) and leverage(v).sum() == pytest.approx(1)
    assert set(column_select(v, 100.0, 1)) == set(range(6)) and list(column_select(v, 2.0, 1)) == list(column_select(v, 2.0, 1))
    at = column_select(v, 100.0, 1, leverage_sort=True)
    assert (np.diff(leverage(v)[at]) >= 0).all()
    assert check_ranks(3) == ([1, 2, 3], [21, 22, 23]) and check_ranks(5, 2, 4) == ([2], [4]) and check_ranks(5, [1, 2], 4) == ([1, 2], [4, 4])
    for bad in ((3, 4), (3, [1], [1, 2]), (3, [1], [0])):
        with pytest.raises(ValueError):
            check_ranks(*bad)
    assert rank_list(None, 4) == [2, 3, 4] and rank_list(3, 9) == [2, 3] and rank_list((2, 8), 9) == [2, 8]
    with pytest.raises(ValueError):
        rank_list("3", 4)
