"""Penalised models of any family on rows that stay distributed: all models (boots, settings, supports) step together.

One pass gives the Gram matrix G of the standardised features. For a model on n_b of the n rows, bound * n / n_b * G is at least the second
derivative of its mean loss, wherever it is (for several outputs of each output by itself), so this one matrix serves every step of every model: a step minimises
the quadratic with that matrix plus the penalty, by coordinate descent over all models at once, and costs one aggregate of outputs *
(features + 1) gradients a model. Steps carry momentum, which starts again where it leads astray. A family without a bound has its
curvature looked for: a step that the loss contradicts is taken back, with twice the curvature. Designs of over ``WIDE`` features
use the diagonal matrix of G's row bounds instead, so no matrix of features by features is made.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsonde.operators import families, kernels, stability, suffstats
from sparsonde.operators.design import Design
from sparsonde.operators.resample import cutoffs, hash_array

from .linear import information_criteria

#: Outputs of all models of one pass.
OUTPUTS_AT_ONCE = 512
#: Linear predictors that a task holds at once.
CELLS = 1 << 22
WIDE = 2000


@dataclass
class State:
    """A model on its way: coefficients (outputs x (features + 1), the intercept last), the point where the gradient is taken, momentum and curvature."""

    w: np.ndarray
    y: np.ndarray
    t: float
    curvature: float
    next: np.ndarray | None = None
    loss_y: float = 0.0
    grad_y: np.ndarray | None = None


class LockstepFit:
    def __init__(self, family: families.Family, df: DataFrame, design: Design, label: str, id_col: str, intercept: bool, max_iter: int, tol: float, stratum: str | None = None) -> None:
        self.family, self.design, self.label, self.id_col, self.intercept, self.max_iter, self.tol = family, design, label, id_col, intercept, max_iter, tol
        self.stratum = "stratum__" if stratum else None
        self.df = df.select(id_col, *design.columns, F.col(label).cast("double").alias("y__"), *([F.col(stratum).alias("stratum__")] if stratum else [])).persist()
        self.p, self.k = design.p, family.outputs
        self.passes = 0
        self.unsettled = 0

    def cuts(self, boots: int, fraction: float, seed: int) -> dict:
        return {(r["boot"], r["stratum"] if self.stratum else None): (r["cut_h"], r["cut_id"]) for r in cutoffs(self.df, self.id_col, boots, fraction, seed, self.stratum).collect()}  # a row per boot and stratum

    def _over_blocks(self, sums: Callable) -> dict[int, np.ndarray]:
        """``sums(block, y, ids, strata, place)`` of each part of a batch, a dict of arrays, added up over all rows."""
        design, id_col, stratum, rows = self.design, self.id_col, self.stratum, max(CELLS // OUTPUTS_AT_ONCE, 64)

        def run(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for part in design.parts(batch, rows):
                    strata, place = suffstats.strata_of(part, stratum) if stratum else ([None], np.zeros(part.num_rows, np.int64))
                    for key, s in sums(design.block(part), part.column("y__").to_numpy(), part.column(id_col).cast(pa.int64()).to_numpy(), strata, place).items():
                        total[key] = total.get(key, 0) + s
            return total

        self.passes += 1
        with design.rows_of_batch(self.df):
            return suffstats.summed(self.df, run)

    def evaluate(self, points: dict[tuple, np.ndarray], cuts: dict, seed: int, side: str = "train") -> dict[tuple, tuple[float, float, float, np.ndarray]]:
        """Rows, mean loss, share of right labels and gradient of the mean loss at each point; a key's first part is the boot whose ``side`` counts."""
        keys, p, k, intercept = list(points), self.p, self.k, self.intercept
        every = np.array([points[m] for m in keys])  # points x outputs x (p + 1)
        coefs, intercepts = every[:, :, :p].reshape(-1, p).T.copy(), every[:, :, p].ravel()
        shipped = families.by_value(self.family)

        def sums(block, y, ids, strata, place) -> dict[int, np.ndarray]:
            family = cloudpickle.loads(shipped)
            eta = block.times(coefs) + intercepts
            left, out = np.zeros_like(eta), np.zeros((len(keys), 3))
            rows: dict[int, np.ndarray] = {}
            for i, m in enumerate(keys):
                if m[0] not in rows:
                    if side == "all":
                        rows[m[0]] = np.ones(len(ids), bool)
                    else:
                        h = hash_array(ids, m[0], seed)
                        ch, ci = np.array([cuts.get((m[0], s), (-1, -1)) for s in strata]).T[:, place]
                        test = (h < ch) | ((h == ch) & (ids <= ci))
                        rows[m[0]] = test if side == "test" else ~test
                at = rows[m[0]]
                e = eta[at, i * k : i * k + k]
                loss, r = family.terms(e, y[at])
                left[at, i * k : i * k + k] = r
                out[i] = at.sum(), loss.sum(), family.right(e, y[at]).sum()
            grad = block.transposed(left).T.reshape(len(keys), k, p)
            last = left.sum(axis=0).reshape(len(keys), k, 1)
            return {i: np.r_[out[i], np.concatenate([grad[i], last[i]], axis=1).ravel()] for i in range(len(keys))}

        found = self._over_blocks(sums)
        out = {}
        for i, m in enumerate(keys):
            n, loss, right, grad = found[i][0], found[i][1], found[i][2], found[i][3:].reshape(k, p + 1)
            n = max(n, 1.0)
            if not intercept:
                grad = np.c_[grad[:, :p], np.zeros(k)]
            out[m] = (found[i][0], loss / n, right / n, grad / n)
        return out

    def prepare(self) -> None:
        """The curvature's matrix, the number of rows and the targets' means, in one pass."""
        p, shipped, wide = self.p, families.by_value(self.family), self.p > WIDE

        def sums(block, y, ids, strata, place) -> dict[int, np.ndarray]:
            total, _ = block.sums()
            if wide:
                metric = block.row_bound() + np.abs(total)
            else:
                x = block.dense()
                metric = (x.T @ x).ravel()
            return {0: np.r_[len(y), total, cloudpickle.loads(shipped).targets(y).sum(axis=0)], 1: metric}

        found = self._over_blocks(sums)
        self.n = found[0][0]
        self.target_means = found[0][1 + p :] / self.n
        first = found[0][1 : 1 + p] / self.n
        if wide:
            self.diagonal = np.r_[found[1] / self.n, 1 + np.abs(first).sum()]
            self.gram = None
        else:
            gram = np.zeros((p + 1, p + 1))
            gram[:p, :p] = found[1].reshape(p, p) / self.n
            gram[:p, p] = gram[p, :p] = first
            gram[p, p] = 1.0
            self.gram = gram if self.intercept else gram[:p, :p]
        self.start = np.zeros((self.k, p + 1))
        if self.intercept:
            self.start[:, p] = np.where(np.isfinite(a := self.family.alone(self.target_means)), a, 0.0)

    def _metric(self, a: np.ndarray) -> np.ndarray:
        """G a of each output."""
        if self.gram is None:
            return a * self.diagonal
        q = len(self.gram)
        return np.c_[a[:, :q] @ self.gram, np.zeros((len(a), self.p + 1 - q))]

    def _norm(self, a: np.ndarray, b: np.ndarray) -> float:
        """a' G b, over all outputs."""
        return float((self._metric(a) * b).sum())

    def _proximal(self, y: np.ndarray, grad: np.ndarray, scale: np.ndarray, lam: np.ndarray, ratio: np.ndarray, masks: np.ndarray | None) -> np.ndarray:
        """The minimum of each quadratic and its penalty; rows are outputs of models, with ``scale`` before the shared matrix."""
        p = self.p
        lam, ratio = (lam / scale)[:, None], ratio[:, None]
        out = np.zeros_like(y)
        if self.gram is None:
            on = np.ones((len(y), p), bool) if masks is None else masks
            d = self.diagonal
            z = d * y - grad / scale[:, None]
            out[:, :p] = np.where(on, kernels.soft(z[:, :p], lam * ratio) / np.maximum(d[:p] + lam * (1 - ratio), 1e-300), 0.0)
            if self.intercept:
                out[:, p] = z[:, p] / d[p]
            return out
        q = len(self.gram)
        cross = y[:, :q] @ self.gram - grad[:, :q] / scale[:, None]
        if lam.any() and masks is None:
            if self.intercept:
                hv = self.gram[p, :p]
                inner, target = self.gram[:p, :p] - np.outer(hv, hv), cross[:, :p] - cross[:, p:] * hv
                out[:, :p] = kernels.descents(inner, target, lam, ratio, y[:, :p], tol=self.tol * 0.1)
                out[:, p] = cross[:, p] - out[:, :p] @ hv
            else:
                out[:, :p] = kernels.descents(self.gram, cross, lam, ratio, y[:, :p], tol=self.tol * 0.1)
            return out
        on = np.ones((len(y), p), bool) if masks is None else masks
        kinds, of = np.unique(on, axis=0, return_inverse=True)
        for i, kind in enumerate(kinds):
            at, rows = np.r_[np.flatnonzero(kind), [p] if self.intercept else []].astype(int), np.flatnonzero(of.ravel() == i)
            key = kind.tobytes()
            if key not in self._inverses:
                self._inverses[key] = np.linalg.pinv(self.gram[np.ix_(at, at)], rcond=1e-10, hermitian=True) if len(at) else np.zeros((0, 0))
            out[np.ix_(rows, at)] = cross[np.ix_(rows, at)] @ self._inverses[key]
        return out

    def solve(self, models: dict[tuple, np.ndarray], settings: dict[tuple, tuple[float, float]], cuts: dict, seed: int, share: float, masks: dict[tuple, np.ndarray] | None = None) -> dict[tuple, np.ndarray]:
        """Each model's coefficients, from a start. ``settings``: penalty and l1 ratio; ``share``: the least share of all rows that a boot has; ``masks``: outputs x features."""
        bound, k, p = self.family.bound, self.k, self.p
        self._inverses: dict[bytes, np.ndarray] = {}
        states = {m: State(w.copy(), w.copy(), 1.0, bound if bound is not None else 1.0) for m, w in models.items()}
        active = set(states)
        for _ in range(self.max_iter):
            now = sorted(active, key=str)
            points = {(*m, 0): states[m].y for m in now if states[m].next is None or bound is not None}
            if bound is None:
                for m in now:
                    if states[m].next is not None:
                        points |= {(*m, 1): states[m].next, (*m, 2): self._ahead(states[m])[0]}
            found = self.evaluate(points, cuts, seed)
            for m in now:
                s = states[m]
                if bound is not None or s.next is None:
                    _, s.loss_y, _, s.grad_y = found[(*m, 0)]
                    continue
                f_next, move = found[(*m, 1)][1], s.next - s.y
                model = s.loss_y + (s.grad_y * move).sum() + s.curvature / share / 2 * self._norm(move, move)
                if f_next > model + 1e-12 * max(1.0, abs(model)) or not np.isfinite(f_next):
                    s.curvature *= 2
                    continue
                s.y, s.t, s.w = *self._ahead(s), s.next
                _, s.loss_y, _, s.grad_y = found[(*m, 2)]
                s.curvature *= 0.95
            lam, ratio = (np.repeat([settings[m][i] for m in now], k) for i in (0, 1))
            scale = np.repeat([states[m].curvature / share for m in now], k)
            rows = np.concatenate([masks[m] for m in now]) if masks is not None else None
            new = self._proximal(np.concatenate([states[m].y for m in now]), np.concatenate([states[m].grad_y for m in now]), scale, lam, ratio, rows)
            for i, m in enumerate(now):
                s, s.next = states[m], new[i * k : i * k + k]
                if s.curvature / share * np.linalg.norm(self._metric(s.next - s.y)) <= self.tol * max(1.0, np.linalg.norm(s.next)):  # the gradient that is left
                    s.w = s.next
                    active.discard(m)
                elif bound is not None:
                    s.y, s.t, s.w = *self._ahead(s), s.next
            if not active:
                break
        else:
            self.unsettled += len(active)
            warnings.warn(f"{len(active)} of {len(states)} models still move after {self.max_iter} steps", RuntimeWarning, stacklevel=3)
        return {m: np.c_[self.family.settled(s.w[:, :p], None if masks is None else masks[m]), s.w[:, p:]] if settings[m][0] == 0 else s.w for m, s in states.items()}

    def _ahead(self, s: State) -> tuple[np.ndarray, float]:
        """Where momentum leads from ``next``; momentum starts anew if the last step turned against it."""
        if self._norm(s.y - s.next, s.next - s.w) > 0:
            return s.next, 1.0
        t = (1 + np.sqrt(1 + 4 * s.t**2)) / 2
        return s.next + (s.t - 1) / t * (s.next - s.w), t

    def stable(self, model, settings: list[tuple[float, float]], per_class: bool, seed: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
        """Coefficients (outputs x features), supports and scores: selection over all settings, refits of all supports, the best of each boot, medians.

        ``model`` has the parameters of a stable model. Settings run ``OUTPUTS_AT_ONCE`` outputs at a time, each such group from the solutions of the one before.
        """
        spark, p, k = self.df.sparkSession, self.p, self.k
        cuts, boots = self.cuts(model.n_boots_sel, model.selection_frac, seed), range(model.n_boots_sel)
        last = {b: self.start for b in boots}
        width = max(1, OUTPUTS_AT_ONCE // (k * model.n_boots_sel))
        tables = []
        for first in range(0, len(settings), width):
            keys = [(b, i) for b in boots for i in range(first, min(first + width, len(settings)))]
            fitted = self.solve({m: last[m[0]] for m in keys}, {m: settings[m[1]] for m in keys}, cuts, seed, model.selection_frac * 0.99)
            last = {b: fitted[b, keys[-1][1]] for b in boots}
            w = np.array([fitted[m][:, :p].ravel() for m in keys])
            b, j = np.indices(w.shape)
            tables.append(pa.table({"boot": pa.array(np.array([m[0] for m in keys])[b.ravel()], pa.int32()), "reg_idx": pa.array(np.array([m[1] for m in keys])[b.ravel()], pa.int32()), "feature": pa.array(j.ravel(), pa.int32()), "coef": w.ravel()}))
        coefs = spark.createDataFrame(pa.concat_tables(tables))
        found = stability.intersections(coefs, stability.thresholds(model.stability_selection, model.n_boots_sel))
        if k > 1 and not per_class:
            found = stability.shared(found, k)
        supports = np.array([r["support"] for r in found.orderBy("support_id").collect()], bool)
        shaped = [s.reshape(k, p) if s.size == k * p else np.tile(s, (k, 1)) for s in supports]
        cuts = self.cuts(model.n_boots_est, model.estimation_frac, seed + 1)
        use = model.estimation_target or ("train" if model.estimation_score in ("AIC", "AICc", "BIC") else "test")
        every, scores = [(b, s) for b in range(model.n_boots_est) for s in range(len(supports))], []
        width = max(1, OUTPUTS_AT_ONCE // k)
        for first in range(0, len(every), width):
            keys = every[first : first + width]
            fitted = self.solve(dict.fromkeys(keys, self.start), dict.fromkeys(keys, (0.0, 1.0)), cuts, seed + 1, model.estimation_frac * 0.99, {m: shaped[m[1]] for m in keys})
            for m, (n, loss, right, _) in self.evaluate(fitted, cuts, seed + 1, use).items():
                if model.estimation_score in ("AIC", "AICc", "BIC"):
                    value = -information_criteria(-loss * n, int(supports[m[1]].sum()), n)[model.estimation_score]
                else:
                    value = right if model.estimation_score == "acc" else -loss
                scores.append((*m, float(value), fitted[m][:, :p].ravel().tolist()))
        table = spark.createDataFrame(scores, "boot int, support_id int, score double, coefs array<double>")
        union = {r["feature"]: r["coef"] for r in stability.median_union(stability.best_supports(table)).collect()}
        return np.array([union[j] for j in range(k * p)]).reshape(k, p), supports, table

    def start_gradient(self) -> np.ndarray:
        """Gradient of the coefficients at the model of intercepts alone (outputs x features)."""
        return self.evaluate({(0,): self.start}, {}, 1, "all")[(0,)][3][:, : self.p]

    def final_intercept(self, coef: np.ndarray) -> np.ndarray:
        """The best intercepts at fixed coefficients; of several outputs the largest is 0."""
        if not self.intercept:
            return np.zeros(self.k)
        p, k, shipped = self.p, self.k, families.by_value(self.family)
        b = self.start[:, p].copy()
        for _ in range(50):

            def sums(block, y, ids, strata, place, b=b) -> dict[int, np.ndarray]:
                family = cloudpickle.loads(shipped)
                eta = block.times(coef.T) + b
                r = family.terms(eta, y)[1]
                small = 1e-5  # of the derivatives in the intercepts, a difference is enough for a Newton step
                turned = [(family.terms(eta + small * np.eye(k)[j], y)[1] - r).sum(axis=0) / small for j in range(k)]
                return {0: np.r_[r.sum(axis=0), np.ravel(turned)]}

            s = self._over_blocks(sums)[0] / self.n
            step = np.clip(-np.linalg.lstsq(s[k:].reshape(k, k), s[:k], rcond=1e-6)[0], -2, 2)
            b = b + step
            if np.abs(step).max() < 1e-8:
                break
        else:
            warnings.warn("the intercepts still move after 50 steps", RuntimeWarning, stacklevel=2)
        return b - b.max() if k > 1 else b

    def close(self) -> None:
        self.df.unpersist()
