"""Whole models and the queries on them."""

from .decomposition import ColumnModel, ColumnSubset, NMFModel, StableColumns, StableNMF
from .glm import DistributedPath, LogisticModel, MaskedLogistic, PoissonGLM, PoissonModel, StableL1Logistic, StablePoisson
from .linear import LinearModel, PathLasso, StableElasticNet, StableLasso

__all__ = [
    "ColumnModel", "ColumnSubset", "DistributedPath", "LinearModel", "LogisticModel", "MaskedLogistic", "NMFModel", "PathLasso", "PoissonGLM", "PoissonModel",
    "StableColumns", "StableElasticNet", "StableL1Logistic", "StableLasso", "StableNMF", "StablePoisson",
]
