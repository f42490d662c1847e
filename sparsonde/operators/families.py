"""Model families: what a generalised linear model is to the fits. A family of one's own subclasses ``Family`` and works in blocks and on distributed rows."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparsonde.functions import columns as fn

from . import kernels


class Family:
    """A loss in the linear predictors eta (rows x outputs). Instances go to the tasks by value.

    ``bound``: a number b such that b times the identity is at least the loss's second derivative in eta, everywhere; None if
    there is none, then fits look for one as they go.
    """

    outputs = 1
    bound: float | None = None

    def terms(self, eta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's loss, and its derivatives in eta (rows x outputs)."""
        raise NotImplementedError

    def targets(self, y: np.ndarray) -> np.ndarray:
        """What the means of the outputs are compared with (rows x outputs)."""
        return y[:, None]

    def alone(self, means: np.ndarray) -> np.ndarray:
        """The outputs' intercepts in a model without features, from the means of the targets."""
        raise NotImplementedError

    def right(self, eta: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether a row's most likely label is its own, where that makes sense."""
        return np.zeros(len(y), bool)

    def settled(self, coef: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """One of the equally good coefficients (outputs x features), where an unpenalised loss doesn't tell."""
        return coef

    def mean(self, eta: Sequence[Column]) -> Column | None:
        """The mean as a column expression."""
        return None


class Logistic(Family):
    """Labels 0 and 1."""

    bound = 0.25

    def terms(self, eta, y):
        return np.logaddexp(0, np.where(y == 1, -eta[:, 0], eta[:, 0])), kernels.sigmoid(eta) - y[:, None]

    def alone(self, means):
        return np.atleast_1d(kernels.intercept_alone(means[0], "logistic"))

    def right(self, eta, y):
        return (eta[:, 0] > 0) == (y == 1)

    def mean(self, eta):
        return fn.sigmoid(eta[0])


class Multinomial(Family):
    """Labels 0 .. classes - 1, an output each."""

    bound = 0.5

    def __init__(self, classes: int) -> None:
        self.outputs = classes

    def targets(self, y):
        return np.eye(self.outputs)[y.astype(int)]

    def terms(self, eta, y):
        top = eta.max(axis=1, keepdims=True)
        e = np.exp(eta - top)
        total = e.sum(axis=1, keepdims=True)
        own = (np.arange(len(y)), y.astype(int))
        r = e / total
        loss = (np.log(total) + top)[:, 0] - eta[own]
        r[own] -= 1
        return loss, r

    def alone(self, means):
        return kernels.intercept_alone(means, "multinomial")

    def right(self, eta, y):
        return eta.argmax(axis=1) == y

    def settled(self, coef, mask):
        free = np.ones(coef.shape[1], bool) if mask is None else mask.all(axis=0)
        return np.where(free[None, :], coef - coef.mean(axis=0), coef)

    def mean(self, eta):
        return fn.softmax(F.array(*eta))


class Poisson(Family):
    """Counts; the predictor is clipped as in the block."""

    def terms(self, eta, y):
        e = np.clip(eta[:, 0], -kernels.ETA, kernels.ETA)
        mu = np.exp(e)
        return mu - y * e, (mu - y)[:, None]

    def alone(self, means):
        return np.atleast_1d(kernels.intercept_alone(means[0], "poisson"))

    def mean(self, eta):
        return F.exp(eta[0])


def by_value(family: Family) -> bytes:
    """The family and its class as bytes: its module needn't be there where they are read."""
    module = sys.modules[type(family).__module__]
    if module.__name__.split(".")[0] == __name__.split(".")[0] or module.__name__ == "__main__":
        return cloudpickle.dumps(family)
    cloudpickle.register_pickle_by_value(module)
    try:
        return cloudpickle.dumps(family)
    finally:
        cloudpickle.unregister_pickle_by_value(module)
