"""Stable lasso and elastic net: resample, fit the path, intersect supports, re-fit without penalty, take the median of the best."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsonde.functions import columns as fn
from sparsonde.operators import frame as fr
from sparsonde.operators import grids, kernels, stability, suffstats
from sparsonde.operators.design import Design
from sparsonde.operators.resample import seed_of, with_row_id

from .wide import WideFit, medians, supports_of

#: Features beyond which no Gram matrix of all of them is made.
WIDE = 2000

SCORES = ("r2", "AIC", "AICc", "BIC")


def information_criteria(ll: float, k: int, n: float) -> dict[str, float]:
    aic = 2 * k - 2 * ll
    return {"AIC": aic, "AICc": aic + (2 * (k * k + k) / (n - k - 1) if n > k + 1 else 0.0), "BIC": k * np.log(n) - 2 * ll}


class Params:
    """Constructor arguments as attributes, with get_params and set_params."""

    def get_params(self, deep: bool = True) -> dict:
        import inspect

        return {k: getattr(self, k) for k in inspect.signature(type(self).__init__).parameters if k != "self"}

    def set_params(self, **values):
        for k, v in values.items():
            if k not in self.get_params():
                raise ValueError(f"{type(self).__name__} has no parameter {k!r}")
            setattr(self, k, v)
        return self


class LinearModel:
    """Coefficients by feature, and predictions as a column expression."""

    def __init__(self, features: Sequence[str], coef: np.ndarray, intercept: float, **more) -> None:
        self.features, self.coef_, self.intercept_ = features if isinstance(features, Design) else list(features), np.asarray(coef, float), float(intercept)
        for k, v in more.items():
            setattr(self, k, v)

    def _predictor(self):
        return self.features.predictor(self.coef_, self.intercept_) if isinstance(self.features, Design) else fn.dot(self.features, self.coef_, self.intercept_)

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, self._predictor())

    def score(self, df: DataFrame, label: str) -> float:
        """R squared."""
        return df.agg(fn.r2(F.col(label), self._predictor())).first()[0]

    def table(self, spark) -> DataFrame:
        """(feature, coef, selected), the intercept last."""
        names = (self.features.names or [f"{self.features.columns[-1]}[{j}]" for j in range(self.features.p)]) if isinstance(self.features, Design) else self.features
        rows = [(f, float(c), bool(c != 0)) for f, c in zip(names, self.coef_, strict=True)]
        return spark.createDataFrame([*rows, ("(intercept)", self.intercept_, True)], "feature string, coef double, selected boolean")

    def save(self, spark, path: str) -> None:
        """The coefficient table as Parquet, the rest as JSON."""
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/coefficients")
        spark.createDataFrame([(json.dumps({"features": self.features, "intercept": self.intercept_}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")

    @classmethod
    def load(cls, spark, path: str):
        about = json.loads(spark.read.text(f"{path}/params").first()[0])
        coef = {r["feature"]: r["coef"] for r in spark.read.parquet(f"{path}/coefficients").collect()}
        return cls(about["features"], [coef[f] for f in about["features"]], about["intercept"])

    def sparsify(self):
        from pyspark.ml.linalg import Vectors

        return Vectors.sparse(len(self.coef_), [(i, c) for i, c in enumerate(self.coef_) if c != 0])


class StableElasticNet(Params):
    """Elastic net by stability selection and model averaging.

    ``fit(df, features, label, id_col)`` makes one pass for the statistics, one for all resamples' Gram matrices, and works on
    those alone from then on: paths in a task per boot, intersections and the choice of supports as Spark aggregates.
    """

    def __init__(self, n_boots_sel=24, n_boots_est=24, selection_frac=0.9, estimation_frac=0.9, n_lambdas=48, stability_selection=1.0, estimation_score="r2", estimation_target=None, alphas=(0.5,), eps=1e-3, warm_start=True, fit_intercept=True, standardize=True, max_iter=1000, tol=1e-4, random_state=None, lambdas=None) -> None:
        own = StableElasticNet.__init__.__code__
        for k in own.co_varnames[1 : own.co_argcount]:
            setattr(self, k, locals()[k])
        if estimation_score not in SCORES:
            raise ValueError(f"estimation_score must be one of {SCORES}, not {estimation_score!r}")
        if estimation_target not in (None, "train", "test"):
            raise ValueError("estimation_target must be 'train' or 'test'")
        stability.thresholds(stability_selection, n_boots_sel)

    def _settings(self, cross: np.ndarray) -> list[tuple[float, float]]:
        if self.lambdas is not None:
            return [(lam, a) for a in self.alphas for lam in self.lambdas]
        return grids.elastic_net_grid(cross, list(self.alphas), self.n_lambdas, self.eps)

    def fit(self, df: DataFrame, features: Sequence[str] | Design, label: str, id_col: str | None = None, stratify: str | None = None) -> LinearModel:
        """``features``: a column each, or a Design. Over ``WIDE`` of them, and designs of arrays, never have a Gram matrix of all (``plans.wide``)."""
        if isinstance(features, Design) and (not features.names or features.p > WIDE):
            return self._fit_wide(df, features, label, id_col, stratify)
        features = features.names if isinstance(features, Design) else list(features)
        if len(features) > WIDE:
            return self._fit_wide(df, Design(features), label, id_col, stratify)
        if id_col is None:
            fr.check(df, features, label)
            df, id_col = with_row_id(df, [*features, label]), "row_id"
        # Read by several passes: what the rows are derived from is worked out once.
        names = [c for c in (*features, label) if c in df.columns]  # one that isn't there fails the check
        df = df.select(*dict.fromkeys([id_col, *names, *([stratify] if stratify else [])])).persist()
        try:
            return self._fit_rows(df, features, label, id_col, stratify)
        finally:
            df.unpersist()

    def _fit_rows(self, df: DataFrame, features: list[str], label: str, id_col: str, stratify: str | None) -> LinearModel:
        fr.check(df, features, label)
        frame = fr.FeatureFrame(df, features, label, id_col)
        full = frame.stats()
        p = len(features)
        if full.y_min == full.y_max:
            return LinearModel(features, np.zeros(p), kernels.intercept_alone(full.y_mean, "linear") if self.fit_intercept else 0.0, supports_=np.zeros((0, p), bool))
        used = fr.Stats(full.n, full.mean if self.fit_intercept else np.zeros(p), full.std, full.y_mean if self.fit_intercept else 0.0, full.y_std, full.y_min, full.y_max)
        if not self.standardize:
            used = fr.Stats(full.n, np.zeros(p), np.ones(p), 0.0, 1.0, full.y_min, full.y_max)
        seed = seed_of(self.random_state)
        grams = suffstats.boot_grams(frame, used, {"sel": (self.n_boots_sel, self.selection_frac, seed), "est": (self.n_boots_est, self.estimation_frac, seed + 1)}, stratify)
        spark = df.sparkSession
        rows = grams.collect()  # boots * (p + 2)^2 numbers
        whole = suffstats.parsed(rows[0]["train"]) + suffstats.parsed(rows[0]["test"])
        settings = self._settings(suffstats.solve_parts(whole, self.fit_intercept)[1])
        kept = spark.createDataFrame([(r["family"], r["boot"], bytes(r["train"]), bytes(r["test"])) for r in rows], "family string, boot int, train binary, test binary").repartition("family", "boot")
        coefs = self._paths(kept.filter("family = 'sel'"), settings)
        limits = stability.thresholds(self.stability_selection, self.n_boots_sel)
        supports = np.array([r["support"] for r in stability.intersections(coefs, limits).orderBy("support_id").collect()], bool).reshape(-1, p)
        scores = self._estimates(kept.filter("family = 'est'"), supports)
        best = stability.best_supports(scores)
        union = {r["feature"]: r["coef"] for r in stability.median_union(best).collect()}
        coef = np.array([union[j] for j in range(p)])
        coef, intercept = fr.restored(coef, full.y_mean, full.mean, used.std, used.y_std)
        intercept = intercept if self.fit_intercept else 0.0
        return LinearModel(features, coef, intercept, supports_=supports, settings_=settings, scores_=scores, coefs_=coefs, best_=best)

    def _fit_wide(self, df: DataFrame, design: Design, label: str, id_col: str | None, stratify: str | None) -> LinearModel:
        fr.check(df, design.names, label)
        design.check(df)
        if id_col is None:
            df, id_col = with_row_id(df, [*design.columns, label]), "row_id"
        p = design.p
        y = fr.FeatureFrame(df, [], label, id_col).stats()
        if y.y_min == y.y_max:
            return LinearModel(design, np.zeros(p), kernels.intercept_alone(y.y_mean, "linear") if self.fit_intercept else 0.0, supports_=np.zeros((0, p), bool))
        _, mean, std = design.moments(df)
        y_mean, y_std = (y.y_mean if self.fit_intercept else 0.0, y.y_std) if self.standardize else (0.0, 1.0)
        # Sparse features keep their zeros: the models' own intercepts stand for the means.
        mean = mean if self.standardize and self.fit_intercept and not design.sparse else np.zeros(p)
        std = std if self.standardize else np.ones(p)
        seed = seed_of(self.random_state)
        fit = WideFit(df, design.scaled(mean, std), label, id_col, y_mean, y_std, self.fit_intercept, stratify)
        given = None if self.lambdas is None else self._settings(np.zeros(0))
        settings, coefs, at = fit.select(given, self._settings, self.n_boots_sel, self.selection_frac, seed, self.warm_start, self.max_iter, self.tol)
        flags = supports_of(coefs, at, stability.thresholds(self.stability_selection, self.n_boots_sel), self.n_boots_sel, len(settings))
        used = np.flatnonzero(np.any(flags, axis=0))
        rows = self._estimator()
        scores = fit.estimate([f[used] for f in flags], at[used], self.n_boots_est, self.estimation_frac, seed + 1, rows)
        small = medians(scores, len(used)) if len(used) else np.zeros(0)
        fit.df.unpersist()
        coef = np.zeros(p)
        coef[at[used]] = small
        supports = np.zeros((len(flags), p), bool)
        supports[:, at] = flags
        coef, _ = fr.restored(coef, 0.0, mean, std, y_std)
        intercept = 0.0
        if self.fit_intercept:
            intercept = y.y_mean - float(coef @ design.moments(df)[1])
        return LinearModel(design, coef, intercept, supports_=supports, settings_=settings, scores_=scores, proposed_=at, passes_=fit.passes)

    def _estimator(self):
        """(boot, support number, score, coefs) of each support: least squares on a boot's training rows, from its augmented Gram matrices."""
        intercept, score = self.fit_intercept, self.estimation_score
        on_test = (self.estimation_target or ("test" if score == "r2" else "train")) == "test"

        def run(boot: int, train: np.ndarray, test: np.ndarray, supports: Sequence[np.ndarray]) -> list[tuple]:
            g, c, m, ym = suffstats.solve_parts(train, intercept)
            out = []
            for s, on in enumerate(supports):
                at = np.flatnonzero(on)
                b = np.zeros(len(on))
                b[at] = kernels.least_squares(g[np.ix_(at, at)], c[at])
                n, rss, sst = suffstats.residual(test if on_test else train, b, ym - m @ b if intercept else 0.0)
                if score == "r2":
                    value = 1 - rss / sst if sst > 0 else 0.0
                else:
                    ll = -n / 2 * (1 + np.log(max(rss / max(n, 1), 1e-300)))
                    value = -information_criteria(ll, len(at), n)[score]
                out.append((boot, s, float(value), b.tolist()))
            return out

        return run

    def _paths(self, grams: DataFrame, settings: list[tuple[float, float]]) -> DataFrame:
        """(boot, reg_idx, feature, coef) of every selection boot: a task per boot and run of settings, warm-started along the path."""
        intercept, warm, more = self.fit_intercept, self.warm_start, {"max_iter": self.max_iter, "tol": self.tol}
        slots = grams.sparkSession.sparkContext.defaultParallelism
        runs = grids.path_chunks(len(settings), grids.chunks_for(self.n_boots_sel, len(settings), slots), warm)
        if len(runs) > 1:
            grams = grams.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(len(runs) - 1)))).repartition(self.n_boots_sel * len(runs), "boot", "run")
        else:
            grams = grams.withColumn("run", F.lit(0))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for r in f.itertuples():
                    g, c, _, _ = suffstats.solve_parts(suffstats.parsed(r.train), intercept)
                    before, own = runs[r.run]
                    b = kernels.path(g, c, [settings[i] for i in before + own], warm, **more)[len(before) :]
                    i, j = np.indices(b.shape)
                    yield pd.DataFrame({"boot": r.boot, "reg_idx": own[0] + i.ravel(), "feature": j.ravel(), "coef": b.ravel()})

        return grams.mapInPandas(run, "boot int, reg_idx int, feature int, coef double")

    def _estimates(self, grams: DataFrame, supports: np.ndarray) -> DataFrame:
        """(boot, support_id, score, coefs): least squares on every support, scored on its boot's rows."""
        rows = self._estimator()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for r in f.itertuples():
                    yield pd.DataFrame(rows(r.boot, suffstats.parsed(r.train), suffstats.parsed(r.test), supports), columns=["boot", "support_id", "score", "coefs"])

        return grams.mapInPandas(run, "boot int, support_id int, score double, coefs array<double>")


class StableLasso(StableElasticNet):
    """As StableElasticNet with the L1 term alone. ``solver``: 'cd', or 'path' for the path solver, which needs an intercept."""

    def __init__(self, n_boots_sel=24, n_boots_est=24, selection_frac=0.9, estimation_frac=0.9, n_lambdas=48, stability_selection=1.0, estimation_score="r2", estimation_target=None, eps=1e-3, warm_start=True, fit_intercept=True, standardize=True, max_iter=1000, tol=1e-4, random_state=None, solver="cd", lambdas=None) -> None:
        if solver not in ("cd", "path"):
            raise ValueError(f"solver must be 'cd' or 'path', not {solver!r}")
        if solver == "path" and not fit_intercept:
            raise ValueError("the path solver needs fit_intercept=True")
        super().__init__(n_boots_sel, n_boots_est, selection_frac, estimation_frac, n_lambdas, stability_selection, estimation_score, estimation_target, (1.0,), eps, warm_start, fit_intercept, standardize, max_iter, tol, random_state, lambdas)
        self.solver = solver


class PathLasso(Params):
    """The lasso along a given list of penalties, on one Gram matrix."""

    def __init__(self, alphas=None, fit_intercept=True, max_iter=1000, tol=1e-4) -> None:
        self.alphas, self.fit_intercept, self.max_iter, self.tol = alphas, fit_intercept, max_iter, tol

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> PathLasso:
        if not self.fit_intercept:
            raise ValueError("fit_intercept must be True")
        if self.alphas is None:
            raise ValueError("alphas must be set")
        fr.check(df, features, label)
        stats = fr.FeatureFrame(df, list(features), label, "").stats()
        shifted = df.select(*[(F.col(c) - float(m)).alias(c) for c, m in zip(features, stats.mean, strict=True)], (F.col(label) - stats.y_mean).alias("y__"))
        a = suffstats.gram_matrix(shifted, [*features, "y__"]) / stats.n
        order = np.argsort(-np.asarray(self.alphas, float), kind="stable")
        b = kernels.path(a[:-1, :-1], a[:-1, -1], [(float(self.alphas[i]), 1.0) for i in order], True, max_iter=self.max_iter, tol=self.tol)
        self.features = list(features)
        self.coef_ = b[np.argsort(order)]
        self.intercept_ = stats.y_mean - self.coef_ @ stats.mean
        return self

    def transform(self, df: DataFrame, output: str = "predictions") -> DataFrame:
        """An array column: a prediction per penalty."""
        if not hasattr(self, "coef_"):
            raise ValueError("the model isn't fitted")
        return df.withColumn(output, F.array(*[fn.dot(self.features, c, b) for c, b in zip(self.coef_, self.intercept_, strict=True)]))
