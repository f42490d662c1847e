"""Functions on columns."""

from .columns import (
    accuracy,
    aic,
    aicc,
    bic,
    dot,
    gaussian_ll,
    log_logistic,
    log_loss,
    logsumexp,
    poisson_ll,
    poisson_mode,
    poisson_response,
    poisson_weight,
    r2,
    sigmoid,
    soft_threshold,
    softmax,
    squared_norm,
)

__all__ = [k for k in dir() if not k.startswith("_") and k != "columns"]
