"""Factorisation by coordinate descent from singular vectors, in a block and on distributed rows."""

import numpy as np
import pytest

from sparsonde.operators import kernels
from sparsonde.plans.decomposition import StableNMF


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    parts = np.array([[5, 4, 0, 0, 0, 1], [0, 0, 3, 6, 0, 1], [0, 1, 0, 0, 4, 5]], float)
    x = rng.gamma(0.5, 1.0, (200, 3)) @ parts + rng.random((200, 6)) * 0.01
    names = [f"x{j}" for j in range(6)]
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], ["row_id", *names]).repartition(3).cache(), names, x, parts


def _error(x, h):
    w = kernels.nnls_rows(h @ h.T, x @ h.T)
    return ((x - w @ h) ** 2).sum() / 2


@pytest.mark.parametrize("init", ["random", "nndsvd"])
def test_block_and_distributed_agree(table, init):
    df, names, _, parts = table
    fit = lambda mb: StableNMF(2, [3], nmf_solver="cd", nmf_init=init, nmf_beta_loss="frobenius", nmf_tol=1e-6, nmf_max_iter=30, db_eps=0.4, random_state=1, block_mb=mb).fit(df, names, "row_id")
    near, far = fit(256), fit(0)
    assert np.allclose(near.bases_samples_, far.bases_samples_, atol=1e-6) and np.allclose(near.components_, far.components_, atol=1e-6)
    unit = parts / np.linalg.norm(parts, axis=1, keepdims=True)
    assert (far.components_ @ unit.T).max(axis=0).min() > 0.98


def test_descent_is_no_worse_than_multiplying(table):
    _, _, x, _ = table
    gram = x.T @ x
    value, vector = np.linalg.eigh(gram)
    v, s = vector[:, ::-1][:, :3], np.sqrt(value[::-1][:3])
    u = x @ v / s
    start = kernels.nndsvd(v, s, np.linalg.norm(np.maximum(u, 0), axis=0), np.linalg.norm(np.maximum(-u, 0), axis=0))
    assert start.shape == (3, 6) and start.min() >= 0 and (start.max(axis=1) > 0).all()
    for steps in (3, 10, 30):
        by_descent = _error(x, kernels.nmf_cd(x, start, np.ones(len(x)), steps, 0.0))
        by_multiplying = _error(x, kernels.nmf(x, 3, 1, "frobenius", steps, 0.0)[1])
        assert by_descent <= by_multiplying * (1 + 1e-9)
    errors = [_error(x, kernels.nmf_cd(x, start, np.ones(len(x)), n, 0.0)) for n in range(6)]
    assert all(b <= a * (1 + 1e-9) for a, b in zip(errors, errors[1:], strict=False))


def test_what_is_not_supported():
    for bad in ({"nmf_solver": "cd"}, {"nmf_init": "nndsvd"}, {"nmf_solver": "newton"}, {"nmf_init": "nndsvda"}):
        with pytest.raises(ValueError):
            StableNMF(2, **bad)
