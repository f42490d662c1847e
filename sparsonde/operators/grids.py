"""Regularisation paths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _down(top: float, n: int, eps: float) -> list[float]:
    """``n`` values from ``top`` to eps * top, evenly spaced in their logarithms."""
    return [float(top)] if n == 1 else [float(x) for x in top * eps ** (np.arange(n) / (n - 1))]


def lasso_grid(cross: np.ndarray, n_lambdas: int = 48, eps: float = 1e-3) -> list[float]:
    """From the largest absolute mean of x_j y (centred with an intercept) downwards."""
    return _down(np.abs(cross).max(initial=0.0), n_lambdas, eps)


def elastic_net_grid(cross: np.ndarray, alphas: list[float], n_lambdas: int = 48, eps: float = 1e-3) -> list[tuple[float, float]]:
    """(lambda, l1 ratio) pairs, ratio by ratio."""
    return [(lam, a) for a in alphas for lam in _down(np.abs(cross).max(initial=0.0) / a, n_lambdas, eps)]


def logistic_grid(gradient: np.ndarray, n_c: int = 48, eps: float = 1e-5) -> list[float]:
    """Inverse strengths, ascending from 1 / the largest absolute gradient of the intercept-only model."""
    return [1 / x for x in _down(max(np.abs(gradient).max(initial=0.0), 1e-300), n_c, eps)]


def poisson_grid(cross: np.ndarray, alphas: list[float], n_lambdas: int = 48, eps: float = 1e-3) -> list[tuple[float, float]]:
    """As elastic_net_grid, with ``cross`` the means of x_j (y - mean y)."""
    return elastic_net_grid(cross, alphas, n_lambdas, eps)


def path_chunks(settings: int, chunks: int, warm_start: bool = True) -> list[tuple[list[int], list[int]]]:
    """A path's settings in ``chunks`` runs that can be fitted apart: of each the settings that lead to it (a coarse path over the starts of the runs before it) and its own."""
    chunks = max(1, min(chunks, settings))
    cuts = [settings * i // chunks for i in range(chunks + 1)]
    return [(cuts[:i] if warm_start else [], list(range(cuts[i], cuts[i + 1]))) for i in range(chunks)]


def chunks_for(boots: int, settings: int, slots: int, least: int = 4) -> int:
    """Runs of at least ``least`` settings a boot, as many as fill the slots."""
    return max(1, min(slots // max(boots, 1), settings // least))


def lambda_table(df: DataFrame, features: list[str], label: str, n_lambdas: int, eps: float) -> DataFrame:
    """(reg_idx, lambda): the lasso grid of a table as one aggregate, centred."""
    top = F.greatest(*[F.abs(F.covar_pop(c, label)) for c in features], F.lit(0.0))
    grid = df.agg(top.alias("top")).select("top", F.explode(F.sequence(F.lit(0), F.lit(n_lambdas - 1))).alias("reg_idx"))
    return grid.select("reg_idx", (F.col("top") * F.pow(F.lit(float(eps)), F.col("reg_idx") / F.lit(max(n_lambdas - 1, 1)))).alias("lambda"))
