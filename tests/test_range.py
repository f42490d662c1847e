"""The randomised range finder against exact factorisations."""

import numpy as np
import pytest

from sparsonde.plans import decomposition as dc


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 12)) * 0.6 ** np.arange(12) @ rng.standard_normal((12, 30)) + rng.standard_normal((500, 30)) * 0.001
    names = [f"x{j}" for j in range(30)]
    return spark.createDataFrame([tuple(map(float, r)) for r in x], names).repartition(7).cache(), names, x


def test_values_and_leverages_equal_the_exact_ones(table):
    df, names, x = table
    v, values = dc.range_svd(df, names, 5, n_iter=5, seed=1)
    _, s, vt = np.linalg.svd(x)
    assert np.allclose(values, s[:5], rtol=1e-9) and np.allclose(np.abs((v * vt[:5].T).sum(axis=0)), 1, atol=1e-9)
    assert np.abs(dc.leverage(v) - dc.leverage(dc.singular_vectors(df, names, 5, "arpack"))).max() < 1e-6
    assert (v[np.abs(v).argmax(axis=0), np.arange(5)] > 0).all()


def test_power_steps_and_tolerance_matter(table):
    df, names, x = table
    s = np.linalg.svd(x)[1][:8]
    off = lambda n, tol=0.0: np.abs(dc.range_svd(df, names, 8, n_iter=n, seed=1, oversampling=0, tol=tol)[1] / s - 1).max()
    assert off(4) < off(0) and off(9, tol=1e9) == off(1)


def test_the_triangle_is_that_of_all_rows(table):
    df, names, x = table
    r = dc._triangle(df, names, np.eye(30)[:, :6])
    assert np.allclose(r.T @ r, x[:, :6].T @ x[:, :6])
    assert np.allclose(dc._triangle(df.limit(0), names, np.eye(30)[:, :2]), 0)


def test_column_subsets_by_either_way(table):
    df, names, _ = table
    some = [dc.ColumnSubset(5, algorithm=a, random_state=1).fit(df, names, c=4).columns_ for a in ("randomized", "arpack")]
    assert some[0] == some[1]
