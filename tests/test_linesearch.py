"""The interval line search against its conditions and against bisection."""

import warnings

import numpy as np
import pytest

from sparsonde.operators.lbfgs import LBFGS


def _of(value, grad):
    def f(x, g):
        g[...] = grad(x)
        return float(value(x))

    return f


def _rosenbrock(x):
    return (100 * (x[1:] - x[:-1] ** 2) ** 2 + (1 - x[:-1]) ** 2).sum()


def _rosenbrock_grad(x):
    g = np.zeros_like(x)
    g[:-1] += -400 * x[:-1] * (x[1:] - x[:-1] ** 2) - 2 * (1 - x[:-1])
    g[1:] += 200 * (x[1:] - x[:-1] ** 2)
    return g


FUNCTIONS = {
    "square": (_of(lambda x: (x**2).sum(), lambda x: 2 * x), np.array([3.0])),
    "shifted": (_of(lambda x: ((x - 1) ** 2).sum(), lambda x: 2 * (x - 1)), np.array([[4.0, -2.0], [0.5, 9.0]])),
    "quartic": (_of(lambda x: (x**4).sum() + 1, lambda x: 4 * x**3), np.array([2.0])),
    "rosenbrock": (_of(_rosenbrock, _rosenbrock_grad), np.array([-1.2, 1.0, -0.5, 2.0])),
    "far": (_of(lambda x: np.cosh(x / 50).sum(), lambda x: np.sinh(x / 50) / 50), np.array([400.0, -3.0])),
    "narrow": (_of(lambda x: (1e4 * x**2).sum(), lambda x: 2e4 * x), np.array([5.0, 1e-3])),
}


def _run(name, search):
    f, start = FUNCTIONS[name]
    seen, steps = [], []

    def counted(x, g):
        value = f(x, g)
        seen.append((x.copy(), value, g.copy()))
        return value

    x = LBFGS(line_search=search, epsilon=1e-6, max_iterations=300).minimize(counted, start, lambda x, g, fx, *more: steps.append((x.copy(), fx, g.copy())) and None)
    return x, seen, steps


@pytest.mark.parametrize("name", list(FUNCTIONS))
def test_steps_meet_the_strong_wolfe_conditions(name):
    _, seen, steps = _run(name, "morethuente")
    before = seen[0]
    assert steps
    for now in steps:
        d = (now[0] - before[0]).ravel()
        slope = before[2].ravel() @ d
        assert now[1] <= before[1] + 1e-4 * slope + 1e-12 and abs(now[2].ravel() @ d) <= 0.9 * abs(slope) + 1e-12
        before = now


def test_no_more_evaluations_than_bisection():
    total = {}
    for search in ("morethuente", "strongwolfe"):
        for name in FUNCTIONS:
            x, seen, _ = _run(name, search)
            g = np.zeros_like(x)
            FUNCTIONS[name][0](x, g)
            assert np.linalg.norm(g) <= 1e-4 * max(1.0, np.linalg.norm(x))
            total[search] = total.get(search, 0) + len(seen)
    assert total["morethuente"] <= total["strongwolfe"]


def test_what_is_not_defined_ends_the_interval():
    f = _of(lambda x: -np.log(x).sum() + x.sum() if (x > 0).all() else np.inf, lambda x: np.where(x > 0, 1 - 1 / x, np.nan))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        x = LBFGS(line_search="morethuente", epsilon=1e-6, max_iterations=100).minimize(f, np.array([0.01, 5.0]))
    assert np.allclose(x, 1, atol=1e-4)
