"""Paths cut into runs that are fitted apart."""

import numpy as np
import pytest

from sparsonde.operators import grids, kernels
from sparsonde.plans.glm import StableL1Logistic
from sparsonde.plans.linear import StableLasso
from sparsonde.sources import datasets


def test_runs_cover_the_path():
    for n, chunks in ((48, 1), (48, 5), (7, 3), (3, 9), (1, 1)):
        runs = grids.path_chunks(n, chunks)
        assert [i for _, own in runs for i in own] == list(range(n)) and all(own for _, own in runs)
        assert all(before == [own[0] for _, own in runs[:k]] for k, (before, _) in enumerate(runs))
    assert grids.path_chunks(8, 2, False)[1][0] == []
    assert grids.chunks_for(24, 48, 1000) == 12 and grids.chunks_for(24, 48, 16) == 1 and grids.chunks_for(24, 2, 1000) == 1


def test_runs_give_the_chains_coefficients():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((100, 30))
    y = x[:, :4] @ [1, 2, -1, 3] + rng.standard_normal(100)
    gram, cross = x.T @ x / 100, x.T @ y / 100
    settings = [(lam, 1.0) for lam in grids.lasso_grid(cross, 20, 1e-2)]
    chain = kernels.path(gram, cross, settings, tol=1e-9)
    for before, own in grids.path_chunks(20, 5):
        assert np.abs(kernels.path(gram, cross, [settings[i] for i in before + own], tol=1e-9)[len(before) :] - chain[own]).max() < 1e-6


@pytest.mark.parametrize("slots", [2, 16])
def test_models_use_the_slots(spark, monkeypatch, slots):
    """Two boots fill sixteen slots, with the results of one chain a boot."""
    df, _, _ = datasets.linear_regression(spark, 300, 6, 3, snr=20, random_state=2)
    names = [f"x{j}" for j in range(6)]
    seen = []
    real = grids.chunks_for
    monkeypatch.setattr(grids, "chunks_for", lambda boots, settings, _: seen.append(real(boots, settings, slots)) or seen[-1])
    m = StableLasso(n_boots_sel=2, n_boots_est=2, n_lambdas=12, random_state=1, tol=1e-9).fit(df, names, "y", "row_id")
    assert seen == [1 if slots == 2 else 3]
    rows = m.coefs_.toPandas().sort_values(["boot", "reg_idx", "feature"])
    assert len(rows) == 2 * 12 * 6 and not rows.duplicated(["boot", "reg_idx", "feature"]).any()
    monkeypatch.setattr(grids, "chunks_for", lambda *a: 1)
    one = StableLasso(n_boots_sel=2, n_boots_est=2, n_lambdas=12, random_state=1, tol=1e-9).fit(df, names, "y", "row_id")
    assert np.allclose(rows["coef"], one.coefs_.toPandas().sort_values(["boot", "reg_idx", "feature"])["coef"], atol=1e-6) and np.allclose(m.coef_, one.coef_)


def test_logistic_models_in_runs(spark, monkeypatch):
    df, _, _ = datasets.classification(spark, 300, 5, 3, random_state=6, w_scale=2.0)
    fit = lambda: StableL1Logistic(2, 2, n_C=8, eps=0.05, random_state=1, tol=1e-7, warm_start=True, estimation_score="BIC").fit(df, [f"x{j}" for j in range(5)], "y", "row_id")
    monkeypatch.setattr(grids, "chunks_for", lambda *a: 1)
    one = fit()
    monkeypatch.setattr(grids, "chunks_for", lambda *a: 4)
    four = fit()
    assert np.array_equal(one.supports_, four.supports_) and np.abs(one.coef_ - four.coef_).max() < 1e-4
