"""Limited-memory quasi-Newton minimisation, with an orthant-wise variant for an L1 term. Runs on the driver or in a task."""

from __future__ import annotations

import warnings
from collections import deque
from collections.abc import Callable

import numpy as np

SEARCHES = ("default", "morethuente", "armijo", "wolfe", "strongwolfe")


class LBFGSError(Exception):
    """The minimisation could not go on."""


class AllZeroLBFGSError(LBFGSError):
    """Two iterates in a row were all zero; ``x`` is the last."""

    def __init__(self, message: str, x: np.ndarray) -> None:
        super().__init__(message)
        self.x = x


def _cubic(a: tuple, b: tuple) -> float:
    """The minimum of the cubic with the values and slopes of two points (step, value, slope); nan if it has none."""
    if a[0] == b[0]:
        return np.nan
    d1 = a[2] + b[2] - 3 * (a[1] - b[1]) / (a[0] - b[0])
    root = d1 * d1 - a[2] * b[2]
    d2 = np.sign(b[0] - a[0]) * np.sqrt(root) if root >= 0 else np.nan
    below = b[2] - a[2] + 2 * d2
    return b[0] - (b[0] - a[0]) * (b[2] + d2 - d1) / below if below else np.nan


def _secant(a: tuple, b: tuple) -> float:
    """Where the slope between two points reaches zero; nan if it never does."""
    return b[0] - b[2] * (b[0] - a[0]) / (b[2] - a[2]) if b[2] != a[2] else np.nan


def _trial(best: tuple, end: tuple, here: tuple, bracketed: bool, low: float, high: float) -> tuple[float, bool]:
    """The next step of an interval search, and whether the interval holds a minimum for certain: by what ``here`` shows against ``best``."""
    t, c = here[0], _cubic(best, here)
    if here[1] > best[1]:  # higher: a minimum lies between
        q = best[0] + (t - best[0]) / 2 * best[2] * (t - best[0]) / (best[2] * (t - best[0]) + best[1] - here[1])
        if not np.isfinite(c):
            c = q
        return (c if abs(c - best[0]) < abs(q - best[0]) else (c + q) / 2), True
    s = _secant(best, here)
    if here[2] * best[2] < 0:  # lower, and the slope has turned: between as well
        if not np.isfinite(c):
            c = s
        return (c if abs(c - t) >= abs(s - t) else s), True
    if abs(here[2]) <= abs(best[2]):  # lower, and flatter: further on
        ahead = np.isfinite(c) and (c - t) * (t - best[0]) > 0
        far = end[0] if bracketed else high if t > best[0] else low
        c = c if ahead else far
        s = s if np.isfinite(s) else far
        step = c if (abs(c - t) < abs(s - t)) == bracketed else s
        if bracketed:
            limit = t + 0.66 * (end[0] - t)
            step = min(limit, step) if t > best[0] else max(limit, step)
        return float(np.clip(step, low, high)), bracketed
    if bracketed:  # lower, and steeper
        c = _cubic(end, here)
        return (c if np.isfinite(c) else (t + end[0]) / 2), True
    return (high if t > best[0] else low), False


class LBFGS:
    """Parameters of the minimiser; ``minimize(f, x0, progress, args)`` runs it.

    ``f(x, g, *args)`` returns the value and writes the gradient into ``g``. ``progress(x, g, fx, xnorm, gnorm, step, k,
    evaluations, *args)`` may return a true value to stop. With ``orthantwise_c`` > 0 the L1 norm of x[start:end] times that is added.
    """

    NAMES = ("m", "epsilon", "past", "delta", "max_iterations", "line_search", "max_linesearch", "min_step", "max_step", "ftol", "wolfe", "gtol", "xtol", "orthantwise_c", "orthantwise_start", "orthantwise_end")

    def __init__(self, m=10, epsilon=1e-5, past=0, delta=0.0, max_iterations=0, line_search="default", max_linesearch=20, min_step=1e-20, max_step=1e20, ftol=1e-4, wolfe=0.9, gtol=0.9, xtol=1e-30, orthantwise_c=0.0, orthantwise_start=0, orthantwise_end=-1, stop_at_zero=False) -> None:
        for name in self.NAMES:
            setattr(self, name, locals()[name])
        self.stop_at_zero = stop_at_zero

    def check(self, n: int) -> None:
        bad = [
            (self.m < 1, "m"), (self.epsilon < 0, "epsilon"), (self.past < 0, "past"), (self.delta < 0, "delta"), (self.max_iterations < 0, "max_iterations"),
            (self.line_search not in SEARCHES, "line_search"), (self.max_linesearch < 1, "max_linesearch"), (self.min_step < 0, "min_step"), (self.max_step < self.min_step, "max_step"),
            (self.ftol < 0, "ftol"), (not self.ftol < self.wolfe < 1, "wolfe"), (self.gtol < 0, "gtol"), (self.xtol < 0, "xtol"), (self.orthantwise_c < 0, "orthantwise_c"),
            (not 0 <= self.orthantwise_start <= n, "orthantwise_start"), (self.orthantwise_end > n, "orthantwise_end"),
        ]
        for wrong, name in bad:
            if wrong:
                raise LBFGSError(f"invalid parameter {name}: {getattr(self, name)!r}")

    def minimize(self, f: Callable, x0: np.ndarray, progress: Callable | None = None, args: tuple = ()) -> np.ndarray:
        if not callable(f):
            raise TypeError("f must be callable")
        if progress is not None and not callable(progress):
            raise TypeError("progress must be callable")
        x0 = np.array(x0, dtype=float)
        shape = x0.shape
        x, n = x0.ravel().copy(), x0.size
        self.check(n)
        c, search = self.orthantwise_c, self.line_search
        lo, hi = self.orthantwise_start, self.orthantwise_end if self.orthantwise_end >= 0 else n
        if c > 0 and search not in ("default", "wolfe"):
            warnings.warn("an orthant-wise term needs line_search='wolfe'", stacklevel=3)
        norm1 = lambda v: c * np.abs(v[lo:hi]).sum()

        def evaluate(v: np.ndarray) -> tuple[float, np.ndarray]:
            g = np.zeros(shape)
            value = float(f(v.reshape(shape), g, *args))
            return value + (norm1(v) if c else 0.0), g.ravel()

        def pseudo(v: np.ndarray, g: np.ndarray) -> np.ndarray:
            if not c:
                return g
            out, part, at = g.copy(), g[lo:hi], v[lo:hi]
            at_zero = np.where(part + c < 0, part + c, np.where(part - c > 0, part - c, 0.0))
            out[lo:hi] = np.where(at > 0, part + c, np.where(at < 0, part - c, at_zero))
            return out

        fx, g = evaluate(x)
        pg = pseudo(x, g)
        evaluations, k = 1, 0
        pairs: deque = deque(maxlen=self.m)
        past: deque = deque(maxlen=self.past or 1)
        zeros = 0
        if np.linalg.norm(pg) <= self.epsilon * max(1.0, np.linalg.norm(x)):
            return x.reshape(shape)
        d = -pg
        step = 1.0 / np.linalg.norm(d)
        while True:
            if c:
                got = self._orthant_step(evaluate, x, fx, pg, d, step, lo, hi)
            else:
                got = (self._interval_step if search == "morethuente" else self._plain_step)(evaluate, x, fx, g, d, step, search)
            x1, f1, g1, step, tries, why = got
            evaluations += tries
            if why:
                if why == "increase":
                    raise LBFGSError("the search direction doesn't lead downhill")
                warnings.warn(f"line search ended: {why}", stacklevel=3)
                return x.reshape(shape)
            pg1 = pseudo(x1, g1)
            xnorm, gnorm = np.linalg.norm(x1), np.linalg.norm(pg1)
            k += 1
            if progress is not None and progress(x1.reshape(shape), g1.reshape(shape), f1, xnorm, gnorm, step, k, evaluations, *args):
                return x1.reshape(shape)
            zeros = zeros + 1 if not x1[lo:hi].any() else 0
            if self.stop_at_zero and zeros >= 2:
                raise AllZeroLBFGSError("two iterates in a row are zero", x1.reshape(shape))
            if gnorm <= self.epsilon * max(1.0, xnorm):
                return x1.reshape(shape)
            if self.past:
                if len(past) == self.past and abs((past[0] - f1) / f1) < self.delta:
                    return x1.reshape(shape)
                past.append(f1)
            if self.max_iterations and k >= self.max_iterations:
                warnings.warn("the iteration limit was reached", stacklevel=3)
                return x1.reshape(shape)
            s, y = x1 - x, g1 - g
            ys = y @ s
            if ys > 1e-300:
                pairs.append((s, y, ys))
            x, fx, g, pg = x1, f1, g1, pg1
            d = -pg
            alphas = []
            for s, y, ys in reversed(pairs):
                alphas.append(a := (s @ d) / ys)
                d = d - a * y
            if pairs:
                s, y, ys = pairs[-1]
                d *= ys / (y @ y)
            for (s, y, ys), a in zip(pairs, reversed(alphas), strict=True):
                d = d + (a - (y @ d) / ys) * s
            if c:
                part = d[lo:hi]
                part[part * pg[lo:hi] >= 0] = 0.0
                if not d.any():
                    return x.reshape(shape)
            step = 1.0

    def _plain_step(self, evaluate, x, fx, g, d, step, search):
        """Backtracking until the wanted conditions hold; 'default' means the strong Wolfe conditions by bisection."""
        slope = g @ d
        if slope > 0:
            return x, fx, g, step, 0, "increase"
        low, high = 0.0, np.inf
        for tries in range(1, self.max_linesearch + 1):
            x1 = x + step * d
            f1, g1 = evaluate(x1)
            if f1 > fx + self.ftol * step * slope or not np.isfinite(f1):
                high = step
            elif search == "armijo":
                return x1, f1, g1, step, tries, ""
            else:
                new = g1 @ d
                if new < self.wolfe * slope:
                    low = step
                elif search != "wolfe" and new > -self.wolfe * slope:
                    high = step
                else:
                    return x1, f1, g1, step, tries, ""
            step = (low + high) / 2 if np.isfinite(high) else step * 2.1
            if step < self.min_step:
                return x, fx, g, step, tries, "the step is too small"
            if step > self.max_step:
                return x, fx, g, step, tries, "the step is too large"
            if np.isfinite(high) and high - low <= self.xtol * high:
                return x, fx, g, step, tries, "rounding errors"
        if f1 < fx:
            return x1, f1, g1, step, tries, ""
        return x, fx, g, step, tries, "too many trials"

    def _interval_step(self, evaluate, x, fx, g, d, step, search):
        """Moré and Thuente's search for the strong Wolfe conditions (``ftol``, ``gtol``): an interval that must hold such a step shrinks by cubic and quadratic trial steps.

        Until a step lies below the line of sufficient decrease with a slope above its, trials are chosen on the function less that line, which guarantees that there is one.
        """
        slope = g @ d
        if slope > 0:
            return x, fx, g, step, 0, "increase"
        line = self.ftol * slope
        best = end = (0.0, fx, slope)  # step, value, slope: the best end of the interval and the other
        bracketed, first_stage, width, width_before = False, True, self.max_step - self.min_step, 2 * (self.max_step - self.min_step)
        for tries in range(1, self.max_linesearch + 1):
            low, high = (min(best[0], end[0]), max(best[0], end[0])) if bracketed else (best[0], step + 4 * (step - best[0]))
            step = float(np.clip(step, self.min_step, self.max_step))
            x1 = x + step * d
            f1, g1 = evaluate(x1)
            new = g1 @ d
            if not np.isfinite(f1):  # beyond where the function is defined: the interval ends here
                bracketed, end, step = True, (step, np.inf, np.inf), (best[0] + step) / 2
                continue
            if f1 <= fx + step * line and abs(new) <= self.gtol * -slope:
                return x1, f1, g1, step, tries, ""
            if bracketed and high - low <= self.xtol * high:
                return x, fx, g, step, tries, "rounding errors"
            if step == self.max_step and f1 <= fx + step * line and new <= line:
                return x, fx, g, step, tries, "the step is too large"
            if step == self.min_step and (f1 > fx + step * line or new >= line):
                return x, fx, g, step, tries, "the step is too small"
            first_stage = first_stage and not (f1 <= fx + step * line and new >= min(self.ftol, self.gtol) * slope)
            tilt = line if first_stage and f1 > fx + step * line and f1 <= best[1] else 0.0
            lean = lambda p, tilt=tilt: (p[0], p[1] - tilt * p[0], p[2] - tilt)
            here = (step, f1, new)
            trial, bracketed = _trial(lean(best), lean(end), lean(here), bracketed, low, high)
            b, h = lean(best), lean(here)
            if h[1] > b[1]:
                end = here
            else:
                if h[2] * (b[0] - h[0]) < 0:
                    end = best
                best = here
            if bracketed:
                if abs(end[0] - best[0]) >= 0.66 * width_before:
                    trial = best[0] + (end[0] - best[0]) / 2
                width_before, width = width, abs(end[0] - best[0])
            step = trial
        if f1 < fx:
            return x1, f1, g1, step, tries, ""
        return x, fx, g, step, tries, "too many trials"

    def _orthant_step(self, evaluate, x, fx, pg, d, step, lo, hi):
        """Backtracking within the orthant of x, or that which the negative pseudo-gradient points into where x is 0."""
        side = np.sign(x[lo:hi])
        side = np.where(side == 0, -np.sign(pg[lo:hi]), side)
        for tries in range(1, self.max_linesearch + 1):
            x1 = x + step * d
            part = x1[lo:hi]
            part[part * side <= 0] = 0.0
            f1, g1 = evaluate(x1)
            if f1 <= fx + self.ftol * (pg @ (x1 - x)):
                return x1, f1, g1, step, tries, ""
            step *= 0.5
            if step < self.min_step:
                return x, fx, pg, step, tries, "the step is too small"
        return x, fx, pg, step, tries, "too many trials"


def fmin_lbfgs(f, x0, progress=None, args=(), orthantwise_c=0, orthantwise_start=0, orthantwise_end=-1, m=10, epsilon=1e-5, past=0, delta=0.0, max_iterations=0, line_search="default", max_linesearch=20, min_step=1e-20, max_step=1e20, ftol=1e-4, wolfe=0.9, gtol=0.9, xtol=1e-30) -> np.ndarray:
    """Minimises ``f`` from ``x0``; see LBFGS for the parameters."""
    names = {k: v for k, v in locals().items() if k in LBFGS.NAMES}
    return LBFGS(**names).minimize(f, x0, progress, args)
