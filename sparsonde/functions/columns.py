"""Scalar functions and row-wise kernels as Spark columns: everything stays in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def log_logistic(x: Column) -> Column:
    """ln(sigmoid(x))."""
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once a row: a lambda works out again for each element what it takes from outside."""
    return F.transform(F.array(value), use)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def logsumexp(values: Column) -> Column:
    shifted = lambda a: bound(F.array_max(a), lambda top: top + F.ln(_total(F.transform(a, lambda v: F.exp(v - top)))))
    return bound(values, shifted)


def softmax(values: Column) -> Column:
    """Softmax of an array column, shifted by its largest value; linear in the array's length."""
    shifted = bound(values, lambda a: bound(F.array_max(a), lambda top: F.transform(a, lambda v: F.exp(v - top))))
    return bound(shifted, lambda e: bound(_total(e), lambda total: F.transform(e, lambda x: x / total)))


def squared_norm(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v * v)


def dot(features: Sequence[str], coef: Sequence[float], intercept: float = 0.0) -> Column:
    """Sum of features times constants; zero coefficients drop out, so their columns aren't even read."""
    out = F.lit(float(intercept))
    for name, c in zip(features, coef, strict=True):
        if c != 0:
            out = out + F.col(name) * F.lit(float(c))
    return out


def soft_threshold(x: Column, t: Column | float) -> Column:
    t = t if isinstance(t, Column) else F.lit(float(t))
    return F.signum(x) * F.greatest(F.abs(x) - t, F.lit(0.0))


def poisson_weight(eta: Column) -> Column:
    """Weight of a row in a Poisson least-squares step at linear predictor ``eta``."""
    return F.exp(eta)


def poisson_response(eta: Column, y: Column) -> Column:
    """Working response of a row in a Poisson least-squares step."""
    return eta + y / F.exp(eta) - 1


def poisson_mode(eta: Column) -> Column:
    """Most likely count at linear predictor ``eta``."""
    return F.floor(F.exp(eta))


def aic(ll: Column, k: Column | int) -> Column:
    return 2 * _c(k) - 2 * ll


def aicc(ll: Column, k: Column | int, n: Column | int) -> Column:
    """AIC with its small-sample term where n > k + 1."""
    k, n = _c(k), _c(n)
    return aic(ll, k) + F.when(n > k + 1, 2 * (k * k + k) / F.nullif(n - k - 1, F.lit(0))).otherwise(0.0)


def bic(ll: Column, k: Column | int, n: Column | int) -> Column:
    return _c(k) * F.ln(_c(n).cast("double")) - 2 * ll


def _c(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def gaussian_ll(y: Column, mu: Column) -> Column:
    """Aggregate: -n/2 (1 + ln of the mean squared residual)."""
    return -F.count(y) / 2.0 * (1 + F.ln(F.avg((y - mu) * (y - mu))))


def poisson_ll(y: Column, mu: Column) -> Column:
    """Aggregate: mean of y ln(mu) - mu; for all-zero mu 0 if all y are 0, else -infinity."""
    safe = F.when(mu > 0, mu)
    term = F.when(y == 0, -mu).otherwise(y * F.ln(safe) - mu)
    return F.when(F.max(F.abs(mu)) > 0, F.avg(term)).when(F.max(F.abs(y)) == 0, 0.0).otherwise(F.lit(float("-inf")))


def r2(y: Column, mu: Column) -> Column:
    """Aggregate: coefficient of determination."""
    return 1 - F.sum((y - mu) * (y - mu)) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))


def accuracy(y: Column, label: Column) -> Column:
    return F.avg((y == label).cast("double"))


def log_loss(y: Column, p: Column, eps: float = 1e-15) -> Column:
    """Aggregate: mean negative log-likelihood of 0/1 labels at probability ``p``."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -F.avg(F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q)))
