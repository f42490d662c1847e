"""Stable logistic and Poisson models.

Data of which a task holds at most ``block_mb`` go to the tasks as one block, a task per boot. Larger data stay where they are: each Newton step is
one aggregate over all rows that gives every boot's gradient and weighted Gram matrix at once, and the boots' path solvers
advance in step (``DistributedPath``).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsonde.functions import columns as fn
from sparsonde.operators import families, grids, kernels, stability, suffstats
from sparsonde.operators import frame as fr
from sparsonde.operators.design import Design
from sparsonde.operators.resample import cutoffs, hash_array, seed_of, with_row_id

from .linear import LinearModel, Params, information_criteria
from .lockstep import LockstepFit

BLOCK_MB = 256
#: What a task holds of a block, as a multiple of it: the block, its training rows, ids, hashes and the solver's vectors. The tasks of an executor hold that each.
HELD = 5
#: Models of which one pass sums up gradients and Gram matrices.
MODELS_AT_ONCE = 256


def predictor(features: Design | Sequence[str], coef: np.ndarray, intercept: float):
    return features.predictor(coef, intercept) if isinstance(features, Design) else fn.dot(features, coef, intercept)


class LogisticModel:
    """Coefficients (outputs x features) and intercepts; predictions are column expressions."""

    def __init__(self, features: Sequence[str], coef: np.ndarray, intercept: np.ndarray, classes: Sequence, **more) -> None:
        self.features, self.coef_, self.intercept_, self.classes_ = features if isinstance(features, Design) else list(features), np.atleast_2d(coef), np.atleast_1d(intercept), list(classes)
        for k, v in more.items():
            setattr(self, k, v)

    def _probabilities(self):
        etas = [predictor(self.features, c, b) for c, b in zip(self.coef_, self.intercept_, strict=True)]
        if len(etas) == 1:
            p = fn.sigmoid(etas[0])
            return F.array(1 - p, p)
        return fn.softmax(F.array(*etas))

    def transform(self, df: DataFrame, output: str = "prediction", probability: str = "probability", log_probability: str | None = None) -> DataFrame:
        out = df.withColumn(probability, self._probabilities())
        if log_probability:
            out = out.withColumn(log_probability, F.transform(probability, lambda p: F.ln(p)))
        best = F.array_position(F.col(probability), F.array_max(F.col(probability))).cast("int")
        return out.withColumn(output, F.element_at(F.array(*[F.lit(c) for c in self.classes_]), best))

    def score(self, df: DataFrame, label: str) -> float:
        """Accuracy."""
        return self.transform(df, "p__", "q__").agg(fn.accuracy(F.col(label), F.col("p__"))).first()[0]


class PoissonModel(LinearModel):
    def transform(self, df: DataFrame, output: str = "prediction", mean: str = "mean") -> DataFrame:
        """The mean, and the most likely count."""
        eta = fn.dot(self.features, self.coef_, 0.0)
        if np.isneginf(self.intercept_):
            return df.withColumn(mean, F.lit(0.0)).withColumn(output, F.lit(0).cast("long"))
        return df.withColumn(mean, F.exp(eta + self.intercept_)).withColumn(output, F.floor(F.col(mean)))


def _block(df: DataFrame, names: Sequence[str], id_col: str, n: int, block_mb: float, stratum: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None] | None:
    """The columns as one array, ordered by id, if what a task holds of them is at most ``block_mb``."""
    if n * len(names) * 8 * HELD > block_mb * 2**20:
        return None
    table = df.select(id_col, *names, *([F.col(stratum).alias("stratum__")] if stratum else [])).toArrow()
    ids = table[id_col].cast(pa.int64()).to_numpy()
    order = np.argsort(ids, kind="stable")
    x = np.column_stack([table[c].cast(pa.float64()).to_numpy() for c in names])
    strata = np.array(table["stratum__"].to_pylist(), object)[order] if stratum else None
    return ids[order], x[order], strata


def _train_rows(ids: np.ndarray, boot: int, fraction: float, seed: int, strata: np.ndarray | None) -> np.ndarray:
    h = hash_array(ids, boot, seed)
    train = np.ones(len(ids), bool)
    for s in [None] if strata is None else sorted(set(strata.tolist()), key=str):
        at = np.arange(len(ids)) if s is None else np.flatnonzero(strata == s)
        test = int(np.ceil((1 - fraction) * len(at) - 1e-9))
        train[at[np.lexsort((ids[at], h[at]))[:test]]] = False
    return train


class _Stable(Params):
    """The steps that logistic and Poisson models share; subclasses fit, score and finish."""

    def _check(self, allowed: Sequence[str]) -> None:
        if self.estimation_score not in allowed:
            raise ValueError(f"estimation_score must be one of {tuple(allowed)}, not {self.estimation_score!r}")
        if self.estimation_target not in (None, "train", "test"):
            raise ValueError("estimation_target must be 'train' or 'test'")
        stability.thresholds(self.stability_selection, self.n_boots_sel)

    def _over_boots(self, df: DataFrame, boots: int, run, schema: str) -> DataFrame:
        """``run(number)`` of each of ``boots`` numbers, a task each."""
        return df.sparkSession.range(boots).repartition(boots, "id").mapInPandas(lambda frames: (run(int(b)) for f in frames for b in f["id"]), schema)

    def _stable(self, df: DataFrame, x: np.ndarray, y: np.ndarray, ids: np.ndarray, strata, settings: list, outputs: int, per_class: bool) -> tuple[np.ndarray, np.ndarray, DataFrame]:
        p = x.shape[1]
        seed = seed_of(self.random_state)
        shared = df.sparkSession.sparkContext.broadcast((x, y, ids, strata))
        model, frac_s, frac_e = self, self.selection_frac, self.estimation_frac

        slots = df.sparkSession.sparkContext.defaultParallelism
        runs = grids.path_chunks(len(settings), grids.chunks_for(self.n_boots_sel, len(settings), slots), self.warm_start)

        def select(task: int) -> pd.DataFrame:
            x, y, ids, strata = shared.value
            boot, (before, own) = task // len(runs), runs[task % len(runs)]
            t = _train_rows(ids, boot, frac_s, seed, strata)
            b = model._path(x[t], y[t], [settings[i] for i in before + own])[len(before) :]  # settings x (outputs * features)
            i, j = np.indices(b.shape)
            return pd.DataFrame({"boot": boot, "reg_idx": own[0] + i.ravel(), "feature": j.ravel(), "coef": b.ravel()})

        coefs = self._over_boots(df, self.n_boots_sel * len(runs), select, "boot int, reg_idx int, feature int, coef double")
        found = stability.intersections(coefs, stability.thresholds(self.stability_selection, self.n_boots_sel))
        if outputs > 1 and not per_class:
            found = stability.shared(found, outputs)
        supports = np.array([r["support"] for r in found.orderBy("support_id").collect()], bool)

        def estimate(boot: int) -> pd.DataFrame:
            x, y, ids, strata = shared.value
            t = _train_rows(ids, boot, frac_e, seed + 1, strata)
            out = []
            for s, on in enumerate(supports):
                coef, intercept = model._refit(x[t], y[t], on)
                use = (model.estimation_target or ("train" if model.estimation_score in ("AIC", "AICc", "BIC") else "test")) == "train"
                rows = t if use else ~t
                out.append((boot, s, float(model._score(x[rows], y[rows], coef, intercept, on)), coef.ravel().tolist()))
            return pd.DataFrame(out, columns=["boot", "support_id", "score", "coefs"])

        scores = self._over_boots(df, self.n_boots_est, estimate, "boot int, support_id int, score double, coefs array<double>")
        best = stability.best_supports(scores)
        union = {r["feature"]: r["coef"] for r in stability.median_union(best).collect()}
        return np.array([union[j] for j in range(outputs * p)]).reshape(outputs, p), supports, scores


class StableL1Logistic(_Stable):
    """L1 logistic regression of two or more classes, by stability selection and model averaging."""

    def __init__(self, n_boots_sel=24, n_boots_est=24, selection_frac=0.9, estimation_frac=0.9, n_C=48, stability_selection=1.0, estimation_score="acc", estimation_target=None, multi_class="auto", shared_support=True, warm_start=False, eps=1e-5, fit_intercept=True, standardize=True, max_iter=10000, tol=1e-3, random_state=None, Cs=None, block_mb=BLOCK_MB) -> None:
        for k in self.__init__.__code__.co_varnames[1 : self.__init__.__code__.co_argcount]:
            setattr(self, k, locals()[k])
        fr.output_dim(2, multi_class)
        self._check(("acc", "log", "AIC", "AICc", "BIC"))

    def _path(self, x, y, settings):
        coefs, _ = kernels.logistic_path(x, y, self._classes, settings, "l1", self.fit_intercept, self.warm_start, max_iter=self.max_iter, tol=self.tol, multinomial=self._outputs > 1)
        return coefs.reshape(len(settings), -1)

    def _refit(self, x, y, on):
        k, p, multi = self._classes, x.shape[1], self._outputs > 1
        if not on.any():
            return np.zeros((self._outputs, p)), self._alone(y)
        if multi and len(on) == self._outputs * p and not self.shared_support:
            return kernels.fit_logistic(x, y, k, "l2", np.inf, self.fit_intercept, mask=on.reshape(self._outputs, p), max_iter=self.max_iter, tol=self.tol, multinomial=True)
        at = np.flatnonzero(on[:p])
        coef = np.zeros((self._outputs, p))
        coef[:, at], b = kernels.fit_logistic(x[:, at], y, k, "l2", np.inf, self.fit_intercept, max_iter=self.max_iter, tol=self.tol, multinomial=multi)
        return coef, b

    def _alone(self, y) -> np.ndarray:
        if self._outputs == 1:
            return np.array([kernels.intercept_alone(y.mean(), "logistic")])
        return kernels.intercept_alone(np.bincount(y, minlength=self._outputs) / len(y), "multinomial")

    def _score(self, x, y, coef, intercept, on) -> float:
        eta = x @ coef.T + intercept
        if self._outputs == 1:
            eta = np.column_stack([np.zeros(len(x)), eta[:, 0]])
        if self.estimation_score == "acc":
            return (eta.argmax(axis=1) == y).mean()
        ll = np.log(np.maximum(kernels.softmax(eta)[np.arange(len(y)), y], 1e-300)).mean()
        if self.estimation_score == "log":
            return ll
        return -information_criteria(ll * len(y), int(np.count_nonzero(on)), len(y))[self.estimation_score]

    def fit(self, df: DataFrame, features: Sequence[str] | Design, label: str, id_col: str | None = None, stratify: str | None = None) -> LogisticModel:
        """``features``: a column each, or a Design; one of arrays is never spread over columns, and sparse rows stay sparse (they can't be centred)."""
        of_arrays = isinstance(features, Design) and not features.names
        names = features.columns if isinstance(features, Design) else list(features)
        fr.check(df, [] if of_arrays else names, label)
        if of_arrays:
            features.check(df)
        else:
            features = names
        if id_col is None:
            df, id_col = with_row_id(df, [*names, label]), "row_id"
        rows = df.groupBy(label).count().orderBy(label).collect()  # a row per class
        classes = [r[0] for r in rows]
        if len(classes) < 2:
            raise ValueError("at least two classes are needed")
        self._classes, self._outputs = len(classes), fr.output_dim(len(classes), self.multi_class)
        data = fr.encoded(df, label, "y__")
        if of_arrays:
            _, mean, std = features.moments(data)
            mean, std = mean if self.standardize and self.fit_intercept else np.zeros(features.p), std if self.standardize else np.ones(features.p)
            family = families.Multinomial(len(classes)) if self._outputs > 1 else families.Logistic()
            fit = LockstepFit(family, data, features.scaled(mean, std), "y__", id_col, self.fit_intercept, self.max_iter, self.tol, stratify)
            return self._lockstep(fit, classes, mean, std, features)
        frame = fr.FeatureFrame(data, features, "y__", id_col)
        stats = frame.stats()
        mean = stats.mean if self.standardize and self.fit_intercept else np.zeros(len(features))
        std = stats.std if self.standardize else np.ones(len(features))
        held = _block(data, [*features, "y__"], id_col, stats.n, self.block_mb, stratify)
        if held is None:
            return self._fit_distributed(data, features, id_col, mean, std, classes, [r[1] for r in rows], stratify)
        ids, block, strata = held
        x, y = (block[:, :-1] - mean) / std, block[:, -1].astype(int)
        settings = list(self.Cs) if self.Cs is not None else grids.logistic_grid(self._start_gradient(x, y), self.n_C, self.eps)
        coef, supports, scores = self._stable(df, x, y, ids, strata, settings, self._outputs, not self.shared_support)
        intercept = kernels.intercept_of_logistic(x @ coef.T, y) if self.fit_intercept else np.zeros(self._outputs)
        coef, intercept = fr.restored(coef, intercept, mean, std)
        return LogisticModel(features, coef, intercept, classes, supports_=supports, scores_=scores, settings_=settings)

    def _start_gradient(self, x, y) -> np.ndarray:
        """Gradient of the coefficients at the intercept-only model."""
        share = np.bincount(y, minlength=self._classes) / len(y) if self.fit_intercept else np.full(self._classes, 1 / self._classes)
        g = x.T @ (share[None, :] - np.eye(self._classes)[y]) / len(y)
        return g if self._outputs > 1 else g[:, 1]

    def _fit_distributed(self, data, features, id_col, mean, std, classes, counts, stratify) -> LogisticModel:
        if self._outputs > 1:
            fit = LockstepFit(families.Multinomial(len(classes)), data, Design(features).scaled(mean, std), "y__", id_col, self.fit_intercept, self.max_iter, self.tol, stratify)
            return self._lockstep(fit, classes, mean, std, features)
        fit = DistributedPath("logistic", data, features, "y__", id_col, mean, std, self.fit_intercept, self.max_iter, self.tol, stratify)
        coef, _, more = fit.stable(self)
        intercept = fit.final_intercept(coef)
        fit.df.unpersist()
        coef, intercept = fr.restored(coef, intercept, mean, std)
        return LogisticModel(features, coef[None, :], np.array([intercept]), classes, **more)


    def _lockstep(self, fit: LockstepFit, classes, mean, std, features) -> LogisticModel:
        fit.prepare()
        settings = list(self.Cs) if self.Cs is not None else grids.logistic_grid(fit.start_gradient(), self.n_C, self.eps)
        coef, supports, scores = fit.stable(self, [(1 / c, 1.0) for c in settings], not self.shared_support, seed_of(self.random_state))
        intercept = fit.final_intercept(coef)
        fit.close()
        return LogisticModel(features, *fr.restored(coef, intercept, mean, std), classes, supports_=supports, scores_=scores, settings_=settings, passes_=fit.passes)


class StablePoisson(_Stable):
    """Elastic-net Poisson regression, by stability selection and model averaging."""

    def __init__(self, n_boots_sel=24, n_boots_est=24, selection_frac=0.8, estimation_frac=0.8, n_lambdas=48, alphas=(1.0,), stability_selection=1.0, estimation_score="log", estimation_target=None, solver="lbfgs", warm_start=True, eps=1e-3, tol=1e-5, max_iter=1000, fit_intercept=True, standardize=True, random_state=None, block_mb=BLOCK_MB) -> None:
        for k in self.__init__.__code__.co_varnames[1 : self.__init__.__code__.co_argcount]:
            setattr(self, k, locals()[k])
        if solver not in ("lbfgs", "cd"):
            raise ValueError(f"solver must be 'lbfgs' or 'cd', not {solver!r}")
        self._check(("log", "AIC", "AICc", "BIC"))
        self._outputs = 1

    def _path(self, x, y, settings):
        out, start = [], None
        for lam, a in settings:
            b, b0 = kernels.fit_poisson(x, y, lam, a, self.fit_intercept, solver=self.solver, start=start, max_iter=self.max_iter, tol=self.tol)
            out.append(b)
            start = np.r_[b, b0] if self.warm_start and self.fit_intercept and np.isfinite(b0) else None
        return np.array(out)

    def _refit(self, x, y, on):
        at = np.flatnonzero(on)
        coef = np.zeros((1, x.shape[1]))
        if not len(at):
            return coef, kernels.intercept_alone(y.mean(), "poisson") if self.fit_intercept else 0.0
        coef[0, at], b = kernels.fit_poisson(x[:, at], y, 0.0, 1.0, self.fit_intercept, solver=self.solver, max_iter=self.max_iter, tol=self.tol)
        return coef, b

    def _score(self, x, y, coef, intercept, on) -> float:
        mu = np.exp(np.clip(x @ coef[0] + intercept, -700, kernels.ETA)) if np.isfinite(intercept) else np.zeros(len(y))
        if mu.any():
            ll = (y * np.log(np.maximum(mu, 1e-300)) - mu).mean()
        else:
            ll = 0.0 if not y.any() else -np.inf
        if self.estimation_score == "log":
            return ll
        k = int(np.count_nonzero(on)) + (intercept != 0)  # the intercept counts here
        return -information_criteria(ll * len(y), k, len(y))[self.estimation_score]

    def fit(self, df: DataFrame, features: Sequence[str], label: str, id_col: str | None = None, stratify: str | None = None) -> PoissonModel:
        features = list(features)
        fr.check(df, features, label)
        if id_col is None:
            df, id_col = with_row_id(df, [*features, label]), "row_id"
        stats = fr.FeatureFrame(df, features, label, id_col).stats()
        p = len(features)
        if stats.y_min < 0:
            raise ValueError("counts must not be negative")
        if stats.y_min == stats.y_max:
            b = kernels.intercept_alone(stats.y_mean, "poisson") if self.fit_intercept else 0.0
            return PoissonModel(features, np.zeros(p), b, supports_=np.zeros((0, p), bool))
        mean = stats.mean if self.standardize and self.fit_intercept else np.zeros(p)
        std = stats.std if self.standardize else np.ones(p)
        held = _block(df, [*features, label], id_col, stats.n, self.block_mb, stratify)
        if held is None:
            fit = DistributedPath("poisson", df, features, label, id_col, mean, std, self.fit_intercept, self.max_iter, self.tol, stratify)
            coef, _, more = fit.stable(self)
            b = fit.final_intercept(coef)
            fit.df.unpersist()
            return PoissonModel(features, *fr.restored(coef, b, mean, std), **more)
        ids, block, strata = held
        x, y = (block[:, :-1] - mean) / std, block[:, -1]
        settings = grids.poisson_grid(x.T @ (y - y.mean()) / len(y), list(self.alphas), self.n_lambdas, self.eps)
        coef, supports, scores = self._stable(df, x, y, ids, strata, settings, 1, False)
        b = float(np.log(y.mean() / np.exp(np.clip(x @ coef[0], -700, kernels.ETA)).mean())) if self.fit_intercept else 0.0
        return PoissonModel(features, *fr.restored(coef[0], b, mean, std), supports_=supports, scores_=scores, settings_=settings)


class GLMModel:
    """A fitted model of any family: ``transform`` adds the linear predictors and, if the family knows its expression, the mean."""

    def __init__(self, family: families.Family, features: Sequence[str] | Design, coef: np.ndarray, intercept: np.ndarray, **more) -> None:
        self.family, self.features, self.coef_, self.intercept_ = family, features, coef, intercept
        for k, v in more.items():
            setattr(self, k, v)

    def transform(self, df: DataFrame, output: str = "predictors", mean: str = "mean") -> DataFrame:
        etas = [predictor(self.features, c, float(b)) for c, b in zip(self.coef_, self.intercept_, strict=True)]
        out, expected = df.withColumn(output, F.array(*etas)), self.family.mean(etas)
        return out if expected is None else out.withColumn(mean, expected)


class StableGLM(_Stable):
    """A stable model of any ``family``, one of one's own as well (see operators.families): elastic-net selection over resamples, supports intersected, re-fitted, scored and averaged.

    Up to ``block_mb`` each boot is a task on the whole block; beyond it, and for designs of arrays, all models step together on distributed
    rows. Both find the same minima. ``settings``: (penalty, l1 ratio) pairs instead of a grid. Scores: the mean log-likelihood ('log'), AIC, AICc, BIC.
    """

    def __init__(self, family: families.Family, n_boots_sel=24, n_boots_est=24, selection_frac=0.9, estimation_frac=0.9, n_lambdas=48, alphas=(1.0,), stability_selection=1.0, estimation_score="log", estimation_target=None, shared_support=True, warm_start=True, eps=1e-3, fit_intercept=True, standardize=True, max_iter=1000, tol=1e-5, random_state=None, settings=None, block_mb=BLOCK_MB) -> None:
        for k in self.__init__.__code__.co_varnames[1 : self.__init__.__code__.co_argcount]:
            setattr(self, k, locals()[k])
        self._check(("log", "AIC", "AICc", "BIC"))

    def _of(self) -> families.Family:
        return cloudpickle.loads(self._shipped) if self._shipped else self.family

    def __getstate__(self) -> dict:
        return self.__dict__ | {"family": None}  # the tasks have it by value

    def _path(self, x, y, settings):
        out, start, family = [], None, self._of()
        for lam, ratio in settings:
            coef, b = kernels.fit_family(family, x, y, lam, ratio, self.fit_intercept, None, start, self.max_iter, self.tol)
            out.append(coef.ravel())
            if self.warm_start:
                start = np.vstack([coef.T, b[None, :]]) if self.fit_intercept else coef.T.copy()
        return np.array(out)

    def _refit(self, x, y, on):
        family = self._of()
        mask = on.reshape(family.outputs, -1) if len(on) == family.outputs * x.shape[1] else np.tile(on, (family.outputs, 1))
        return kernels.fit_family(family, x, y, 0.0, 1.0, self.fit_intercept, mask, None, self.max_iter, self.tol)

    def _score(self, x, y, coef, intercept, on) -> float:
        ll = -self._of().terms(x @ coef.T + intercept, y)[0].mean()
        return ll if self.estimation_score == "log" else -information_criteria(ll * len(y), int(np.count_nonzero(on)), len(y))[self.estimation_score]

    def fit(self, df: DataFrame, features: Sequence[str] | Design, label: str, id_col: str | None = None, stratify: str | None = None) -> GLMModel:
        design = features if isinstance(features, Design) else Design(list(features))
        fr.check(df, design.names, label)
        design.check(df)
        if id_col is None:
            df, id_col = with_row_id(df, [*design.columns, label]), "row_id"
        n, mean, std = design.moments(df)
        p, k = design.p, self.family.outputs
        mean, std = mean if self.standardize and self.fit_intercept else np.zeros(p), std if self.standardize else np.ones(p)
        self._shipped = families.by_value(self.family)
        fit = LockstepFit(self.family, df, design.scaled(mean, std), label, id_col, self.fit_intercept, self.max_iter, self.tol, stratify)
        try:
            fit.prepare()
            grid = grids.elastic_net_grid(fit.start_gradient(), list(self.alphas), self.n_lambdas, self.eps) if self.settings is None else list(self.settings)
            held = _block(df, [*design.names, label], id_col, n, self.block_mb, stratify) if design.names else None
            if held is None:
                coef, supports, scores = fit.stable(self, grid, not self.shared_support, seed_of(self.random_state))
            else:
                ids, block, strata = held
                coef, supports, scores = self._stable(df, (block[:, :-1] - mean) / std, block[:, -1], ids, strata, grid, k, not self.shared_support)
            intercept = fit.final_intercept(coef)
        finally:
            fit.close()
        return GLMModel(self.family, features, *fr.restored(coef, intercept, mean, std), supports_=supports, scores_=scores, settings_=grid)


class DistributedPath:
    """Penalised logistic or Poisson paths of all boots in step, on data that stay distributed.

    A Newton step of every boot is one aggregate: each task adds its rows' w x x' and x (y - mu) for each boot at that boot's
    coefficients, so only boots * (p + 1)^2 numbers per task move. The quadratic is minimised by coordinate descent on the driver.
    """

    def __init__(self, family, df, features, label, id_col, mean, std, intercept, max_iter, tol, stratum=None) -> None:
        self.family, self.features, self.label, self.id_col = family, features, label, id_col
        self.stratum = stratum
        # Each step reads the rows anew: they are joined and encoded once, and kept for as long as the fit runs.
        self.df = df.select(id_col, *features, label, *([F.col(stratum).alias("stratum__")] if stratum else [])).persist()
        self.mean, self.std, self.intercept, self.max_iter, self.tol = mean, std, intercept, max_iter, tol

    def _cuts(self, boots, fraction, seed):
        stratum = "stratum__" if self.stratum else None
        return {(r["boot"], r["stratum"] if stratum else None): (r["cut_h"], r["cut_id"]) for r in cutoffs(self.df, self.id_col, boots, fraction, seed, stratum).collect()}  # a row per boot and stratum

    def _sums(self, coefs: dict, cuts: dict, seed: int, side: str = "train") -> dict:
        """Of each model (a boot, or a boot and more): rows, log-likelihood sum, rows whose class is right, gradient and weighted Gram matrix of (features, 1)."""
        stratum = "stratum__" if self.stratum else None
        models = list(coefs)
        names, mean, std, family, id_col = [*self.features, self.label], self.mean, self.std, self.family, self.id_col

        def run(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
            k = len(names)
            sums = {m: np.zeros(3 + k + k * k) for m in models}
            for batch in batches:
                v = suffstats.matrix(batch, names)
                x, y = np.column_stack([(v[:, 1:-1] - mean) / std, v[:, 0]]), v[:, -1]
                ids = batch.column(id_col).cast(pa.int64()).to_numpy()
                strata, place = suffstats.strata_of(batch, stratum) if stratum else ([None], np.zeros(len(ids), np.int64))
                tests: dict[int, np.ndarray] = {}
                for m, coef in coefs.items():
                    b = m[0] if isinstance(m, tuple) else m
                    if b not in tests:
                        h = hash_array(ids, b, seed)
                        ch, ci = np.array([cuts.get((b, s), (-1, -1)) for s in strata]).T[:, place]
                        tests[b] = (h < ch) | ((h == ch) & (ids <= ci))
                    test = tests[b]
                    at = test if side == "test" else ~test if side == "train" else np.ones(len(ids), bool)
                    xb, yb = x[at], y[at]
                    eta = np.clip(xb @ coef, -kernels.ETA, kernels.ETA)
                    if family == "logistic":
                        mu = kernels.sigmoid(eta)
                        w, ll = mu * (1 - mu), -np.logaddexp(0, np.where(yb == 1, -eta, eta)).sum()
                    else:
                        mu = np.exp(eta)
                        w, ll = mu, (yb * eta - mu).sum()
                    right = ((eta > 0) == (yb == 1)).sum() if family == "logistic" else 0
                    sums[m] += np.r_[len(yb), ll, right, xb.T @ (yb - mu), ((xb * w[:, None]).T @ xb).ravel()]
            return {i: sums[m] for i, m in enumerate(models)}

        k = len(names)
        return {models[i]: (s[0], s[1], s[2], s[3 : 3 + k], s[3 + k :].reshape(k, k)) for i, s in suffstats.summed(self.df, run).items()}

    def _fit(self, start, lam, ratio, cuts, seed, masks=None):
        """Coefficients (features, intercept) of every model at one setting, warm-started; ``masks``: of each model its support. One aggregate over all rows per step, for all of them."""
        p = len(self.features)
        coefs, active = {b: c.copy() for b, c in start.items()}, set(start)
        for _ in range(self.max_iter):
            sums = self._sums({b: coefs[b] for b in active}, cuts, seed)
            for b, (n, _, _, grad, gram) in sums.items():
                g, h = grad / n, gram / n + 1e-10 * np.eye(p + 1)
                at = np.arange(p) if masks is None else np.flatnonzero(masks[b])
                c = h @ coefs[b] + g
                if self.intercept:
                    hh, hv = h[p, p], h[p, at]
                    q, r = h[np.ix_(at, at)] - np.outer(hv, hv) / hh, c[at] - hv * c[p] / hh
                else:
                    q, r = h[np.ix_(at, at)], c[at]
                new = np.zeros(p + 1)
                new[at] = kernels.descent(q, r, lam, ratio, coefs[b][at], 500, self.tol * 0.1) if lam else kernels.least_squares(q, r)
                if self.intercept:
                    new[p] = (c[p] - h[p, at] @ new[at]) / h[p, p]
                move = np.clip(new - coefs[b], -5, 5)
                coefs[b] = coefs[b] + move
                if np.abs(move).max() < self.tol:
                    active.discard(b)
            if not active:
                break
        else:
            warnings.warn(f"{len(active)} of {len(start)} models still move after {self.max_iter} steps", RuntimeWarning, stacklevel=2)
        return coefs

    def stable(self, model) -> tuple[np.ndarray, np.ndarray, dict]:
        """Coefficients, supports, and the scores and settings as attributes of a model."""
        p, seed = len(self.features), seed_of(model.random_state)
        zero = np.zeros(p + 1)
        n, _, _, grad, gram = self._sums({0: zero}, {}, seed, "all")[0]
        share = 0.5 + grad[p] / n if self.family == "logistic" else 1 + grad[p] / n
        if self.intercept:
            zero[p] = np.log(share / (1 - share)) if self.family == "logistic" else np.log(share)
        top = self._sums({0: zero}, {}, seed, "all")[0][3][:p] / n
        if self.family == "logistic":
            settings = [(1 / c, 1.0) for c in (grids.logistic_grid(top, model.n_C, model.eps) if model.Cs is None else model.Cs)]
        else:
            settings = grids.poisson_grid(top, list(model.alphas), model.n_lambdas, model.eps)
        cuts = self._cuts(model.n_boots_sel, model.selection_frac, seed)
        now, rows = {b: zero.copy() for b in range(model.n_boots_sel)}, []
        for i, (lam, ratio) in enumerate(settings):
            now = self._fit(now, lam, ratio, cuts, seed)
            rows += [(b, i, j, float(c[j])) for b, c in now.items() for j in range(p)]
        coefs = self.df.sparkSession.createDataFrame(rows, "boot int, reg_idx int, feature int, coef double")
        found = stability.intersections(coefs, stability.thresholds(model.stability_selection, model.n_boots_sel))
        supports = np.array([r["support"] for r in found.orderBy("support_id").collect()], bool)
        cuts = self._cuts(model.n_boots_est, model.estimation_frac, seed + 1)
        use = model.estimation_target or ("train" if model.estimation_score in ("AIC", "AICc", "BIC") else "test")
        scores = []
        every = [(b, s) for b in range(model.n_boots_est) for s in range(len(supports))]
        for first in range(0, len(every), MODELS_AT_ONCE):  # what a task holds is a Gram matrix for each
            some = every[first : first + MODELS_AT_ONCE]
            fitted = self._fit({m: zero.copy() for m in some}, 0.0, 1.0, cuts, seed + 1, {m: supports[m[1]] for m in some})
            for (b, s), (n, ll, right, _, _) in self._sums(fitted, cuts, seed + 1, use).items():
                if model.estimation_score in ("AIC", "AICc", "BIC"):
                    k = int(supports[s].sum()) + (self.family == "poisson" and self.intercept)
                    value = -information_criteria(ll, k, n)[model.estimation_score]
                else:
                    value = (right if model.estimation_score == "acc" else ll) / max(n, 1)
                scores.append((b, s, float(value), fitted[b, s][:p].tolist()))
        table = self.df.sparkSession.createDataFrame(scores, "boot int, support_id int, score double, coefs array<double>")
        union = {r["feature"]: r["coef"] for r in stability.median_union(stability.best_supports(table)).collect()}
        given = settings if self.family == "poisson" else [1 / lam for lam, _ in settings]
        return np.array([union[j] for j in range(p)]), supports, {"supports_": supports, "scores_": table, "settings_": given}

    def final_intercept(self, coef: np.ndarray) -> float:
        """The intercept at fixed coefficients, one aggregate per Newton step."""
        if not self.intercept:
            return 0.0
        c = np.r_[coef, 0.0]
        for _ in range(50):
            n, _, _, grad, gram = self._sums({0: c}, {}, 1, "all")[0]
            step = float(np.clip(grad[-1] / max(gram[-1, -1], 1e-12), -2, 2))
            c[-1] += step
            if abs(step) < 1e-9:
                break
        else:
            warnings.warn("the intercept still moves after 50 steps", RuntimeWarning, stacklevel=2)
        return float(c[-1])


def _over_rows(df: DataFrame, names: Sequence[str], loss, start: np.ndarray, l1: float, penalised: int, max_iter: int, tol: float) -> np.ndarray:
    """The orthant-wise minimiser on rows that stay distributed: a loss and its gradient are one aggregate. ``loss(w, matrix of names)`` gives those of a batch."""
    held = df.select(*names).persist()
    try:
        return kernels.minimise(lambda w: suffstats.mean_loss(held, names, lambda v, w=w.copy(): loss(w, v)), start, l1, penalised, max_iter, tol)
    finally:
        held.unpersist()


class PoissonGLM(Params):
    """One elastic-net Poisson model, ``alpha`` times the penalty. Equal rows, where there are many, are one with a weight. Data beyond ``block_mb`` stay distributed; either solver then is the orthant-wise one."""

    def __init__(self, alpha=1.0, l1_ratio=1.0, fit_intercept=True, standardize=False, max_iter=1000, tol=1e-5, warm_start=False, solver="lbfgs", block_mb=BLOCK_MB) -> None:
        if solver not in ("lbfgs", "cd"):
            raise ValueError(f"solver must be 'lbfgs' or 'cd', not {solver!r}")
        self.alpha, self.l1_ratio, self.fit_intercept, self.standardize, self.max_iter, self.tol, self.warm_start, self.solver, self.block_mb = alpha, l1_ratio, fit_intercept, standardize, max_iter, tol, warm_start, solver, block_mb

    def fit(self, df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, id_col: str | None = None) -> PoissonModel:
        fr.check(df, features, label)
        stats = fr.FeatureFrame(df, list(features), label, id_col or "").stats()
        if (fewer := fr.merged(df, [*features, label], weight)) is not None:
            df, weight, id_col = fewer, "times__", None
        names = [*features, label, *([weight] if weight else [])]
        ids = df if id_col else df.withColumn("id__", F.monotonically_increasing_id())
        p = len(features)
        mean = stats.mean if self.standardize and self.fit_intercept else np.zeros(p)
        std = stats.std if self.standardize else np.ones(p)
        held = _block(ids, names, id_col or "id__", stats.n if fewer is None else fewer.count(), self.block_mb, None)
        if held is not None:
            block = held[1]
            coef, b = kernels.fit_poisson((block[:, :p] - mean) / std, block[:, p], self.alpha, self.l1_ratio, self.fit_intercept, block[:, p + 1] if weight else None, self.solver, max_iter=self.max_iter, tol=self.tol)
        elif stats.y_min == stats.y_max:
            coef, b = np.zeros(p), float(kernels.intercept_alone(stats.y_mean, "poisson")) if self.fit_intercept else 0.0
        else:
            l2 = self.alpha * (1 - self.l1_ratio)
            start = np.r_[np.zeros(p), [np.log(max(stats.y_mean, 1e-10))] if self.fit_intercept else []]
            w = _over_rows(df, names, lambda w, v: kernels.poisson_loss(w, (v[:, :p] - mean) / std, v[:, p], l2, v[:, p + 1] if weight else None), start, self.alpha * self.l1_ratio, p, self.max_iter, self.tol)
            coef, b = w[:p], float(w[p]) if self.fit_intercept else 0.0
        if fewer is not None:
            fewer.unpersist()
        return PoissonModel(features, *fr.restored(coef, b, mean, std))


class MaskedLogistic(Params):
    """One logistic model whose coefficients outside a mask (outputs x features) stay 0. Equal rows, where there are many, are one with a weight. Data beyond ``block_mb`` stay distributed."""

    def __init__(self, penalty="l2", tol=1e-3, C=1.0, fit_intercept=True, standardize=False, class_weight=None, max_iter=10000, multi_class="auto", verbose=0, warm_start=False, block_mb=BLOCK_MB) -> None:
        if penalty not in ("l1", "l2"):
            raise ValueError(f"penalty must be 'l1' or 'l2', not {penalty!r}")
        fr.output_dim(2, multi_class)
        self.penalty, self.tol, self.C, self.fit_intercept, self.standardize, self.class_weight, self.max_iter, self.multi_class, self.verbose, self.warm_start, self.block_mb = penalty, tol, C, fit_intercept, standardize, class_weight, max_iter, multi_class, verbose, warm_start, block_mb

    def fit(self, df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, coef_mask: np.ndarray | None = None) -> LogisticModel:
        features = list(features)
        fr.check(df, features, label)
        rows = df.groupBy(label).count().orderBy(label).collect()  # a row per class
        classes, counts = [r[0] for r in rows], np.array([r[1] for r in rows])
        if len(classes) < 2:
            raise ValueError("at least two classes are needed")
        outputs = fr.output_dim(len(classes), self.multi_class)
        stats = fr.FeatureFrame(df, features, None, "").stats()
        if (fewer := fr.merged(df, [*features, label], weight)) is not None:
            df, weight = fewer, "times__"
        data = fr.encoded(df, label, "y__").withColumn("id__", F.monotonically_increasing_id())
        names = [*features, "y__", *([weight] if weight else [])]
        p, k = len(features), len(classes)
        held = _block(data, names, "id__", stats.n if fewer is None else fewer.count(), self.block_mb, None)
        mean = stats.mean if self.standardize and self.fit_intercept else np.zeros(p)
        std = stats.std if self.standardize else np.ones(p)
        each = np.ones(k)
        if self.class_weight is not None:
            each = counts.sum() / (k * counts) if self.class_weight == "balanced" else np.array([self.class_weight.get(c, 1.0) for c in classes])
        mask = None if coef_mask is None else np.asarray(coef_mask, bool).reshape(outputs, p)

        def parts(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            y = v[:, p].astype(int)
            return (v[:, :p] - mean) / std, y, each[y] * (v[:, p + 1] if weight else 1.0)

        if mask is not None and not mask.any():
            coef, b = np.zeros((outputs, p)), np.zeros(outputs)
            if self.fit_intercept:
                share = counts / counts.sum()
                b = np.atleast_1d(kernels.intercept_alone(share[1], "logistic") if outputs == 1 else kernels.intercept_alone(share, "multinomial"))
        elif held is not None:
            x, y, s = parts(held[1])
            coef, b = kernels.fit_logistic(x, y, k, self.penalty, self.C, self.fit_intercept, mask, s, max_iter=self.max_iter, tol=self.tol, multinomial=outputs > 1)
        else:
            strength = 0.0 if np.isinf(self.C) else 1.0 / self.C
            l1, l2 = (strength, 0.0) if self.penalty == "l1" else (0.0, strength)
            on = None if mask is None else mask.T.astype(float)  # features x outputs

            def loss(w: np.ndarray, v: np.ndarray) -> tuple[float, np.ndarray]:
                x, y, s = parts(v)
                if outputs == 1:
                    return kernels.logistic_loss(w, x, np.where(y == 1, 1.0, -1.0), l2, None if on is None else on[:, 0], s)
                return kernels.multinomial_loss(w.reshape(-1, outputs), x, np.eye(outputs)[y], l2, on, s)

            w = _over_rows(data, names, loss, np.zeros((p + self.fit_intercept) * outputs), l1, p * outputs, self.max_iter, self.tol).reshape(-1, outputs)
            coef, b = (w[:p] * (1.0 if on is None else on)).T, w[p] if self.fit_intercept else np.zeros(outputs)
        if fewer is not None:
            fewer.unpersist()
        return LogisticModel(features, *fr.restored(coef, b, mean, std), classes)
