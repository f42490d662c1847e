"""Screened paths, least squares by shared passive sets, zero exits and warnings."""

import warnings

import numpy as np
import pytest

from sparsonde.operators import kernels


def _problem(seed, n=150, p=120, on=5):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, p)) + 0.4 * rng.standard_normal((n, 1))
    y = x[:, :on] @ rng.uniform(1, 3, on) + rng.standard_normal(n)
    x, y = x - x.mean(axis=0), y - y.mean()
    return x.T @ x / n, x.T @ y / n


@pytest.mark.parametrize("warm", [True, False])
@pytest.mark.parametrize("ratio", [1.0, 0.5])
def test_screened_paths_are_the_same_with_fewer_updates(warm, ratio):
    for seed in range(2):
        gram, cross = _problem(seed)
        top = np.abs(cross).max() / ratio
        settings = [(lam, ratio) for lam in top * 0.1 ** (np.arange(12) / 11)]
        every, some = [0], [0]
        a = kernels.path(gram, cross, settings, warm, False, tol=1e-9, max_iter=5000, counter=every)
        b = kernels.path(gram, cross, settings, warm, True, tol=1e-9, max_iter=5000, counter=some)
        assert np.abs(a - b).max() < 1e-6 and ((a != 0) == (b != 0)).all()
        assert some[0] < every[0] * (1 / 3 if ratio == 1 else 0.8)


def test_a_penalty_above_the_gradient_needs_no_descent():
    gram, cross = _problem(1)
    count = [0]
    assert not kernels.path(gram, cross, [(np.abs(cross).max() * 1.01, 1.0)], counter=count).any() and count == [0]
    assert not kernels.path(gram, np.zeros_like(cross), [(0.1, 1.0)]).any()


def test_settings_in_any_order():
    gram, cross = _problem(2)
    settings = [(0.05, 1.0), (1.0, 1.0), (0.2, 0.3), (0.01, 1.0), (0.0, 1.0)]
    a = kernels.path(gram, cross, settings, screen=False, tol=1e-10, max_iter=20000)
    assert np.abs(kernels.path(gram, cross, settings, tol=1e-10, max_iter=20000) - a).max() < 1e-5


def test_rows_of_least_squares_at_once():
    rng = np.random.default_rng(5)
    for k in (1, 3, 8):
        a = rng.random((30, k))
        x = np.vstack([rng.standard_normal((60, 30)), rng.random((20, k)) @ a.T, np.zeros((2, 30))])
        got = kernels.nnls_rows(a.T @ a, x @ a)
        assert got.min() >= 0
        for g, row in zip(got, x @ a, strict=True):
            assert np.allclose(g, kernels.nnls(a.T @ a, row), atol=1e-8)
    assert kernels.nnls_rows(np.eye(3), np.zeros((0, 3))).shape == (0, 3)


def test_rows_of_a_singular_system():
    rng = np.random.default_rng(6)
    a = rng.random((20, 3))
    a = np.c_[a, a[:, 0]]
    x = rng.standard_normal((30, 20))
    got = kernels.nnls_rows(a.T @ a, x @ a)
    for g, row in zip(got, x, strict=True):
        best = kernels.nnls(a.T @ a, row @ a)
        assert g.min() >= 0 and np.linalg.norm(a @ g - row) <= np.linalg.norm(a @ best - row) + 1e-8


def test_zero_coefficients_are_known_at_the_start():
    rng = np.random.default_rng(7)
    x, y = rng.standard_normal((80, 4)), (rng.random(80) < 0.3).astype(int)
    top = np.abs(x.T @ (y.mean() - y)).max() / 80
    seen = []
    real = kernels.logistic_loss

    def counted(*args):
        seen.append(1)
        return real(*args)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(kernels, "logistic_loss", counted)
        coef, b = kernels.fit_logistic(x, y, 2, "l1", 1 / (top * 1.01))
    assert not coef.any() and b[0] == pytest.approx(np.log(y.mean() / (1 - y.mean()))) and len(seen) == 1
    far, c = kernels.fit_logistic(x, y, 2, "l1", 1 / (top * 1.5), start=np.r_[np.full(4, 0.3), 2.0], tol=1e-8)
    assert not far.any() and c[0] == pytest.approx(b[0], abs=1e-5)
    three = rng.integers(0, 3, 80)
    assert not kernels.fit_logistic(x, three, 3, "l1", 1e-3)[0].any()


def test_an_iteration_limit_is_told():
    rng = np.random.default_rng(8)
    x, y = rng.standard_normal((80, 4)), (rng.random(80) < 0.3).astype(int)
    with pytest.warns(RuntimeWarning):
        kernels.fit_logistic(x, y, 2, "l2", 10.0, max_iter=1, tol=1e-12)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        kernels.fit_logistic(x, y, 2, "l2", 10.0, max_iter=500, tol=1e-4)
