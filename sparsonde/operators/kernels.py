"""Small dense solvers, used on sufficient statistics or on one block of data. numpy only."""

from __future__ import annotations

import numpy as np

from .lbfgs import LBFGS, AllZeroLBFGSError

ETA = 30.0  # linear predictors are clipped to +-ETA before exp


def soft(x, t):
    return np.sign(x) * np.maximum(np.abs(x) - t, 0.0)


def softmax(y: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(y - y.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def sigmoid(x):
    return np.exp(-np.logaddexp(0, -np.asarray(x, float)))


def descent(gram: np.ndarray, cross: np.ndarray, lam: float, ratio: float = 1.0, start: np.ndarray | None = None, max_iter: int = 1000, tol: float = 1e-4, counter: list[int] | None = None) -> np.ndarray:
    """argmin of b'Gb/2 - c'b + lam (ratio |b|_1 + (1 - ratio) |b|^2 / 2) by cyclic coordinate descent on the Gram matrix. ``counter[0]`` grows by the coordinates looked at."""
    p = len(cross)
    b = np.zeros(p) if start is None else start.copy()
    grad = cross - gram @ b
    diag = np.diag(gram).copy()
    for _ in range(max_iter):
        most = 0.0
        if counter is not None:
            counter[0] += p
        for j in range(p):
            if diag[j] <= 0:
                continue
            old = b[j]
            new = soft(grad[j] + diag[j] * old, lam * ratio) / (diag[j] + lam * (1 - ratio))
            if new != old:
                grad -= gram[:, j] * (new - old)
                b[j] = new
                most = max(most, abs(new - old))
        if most <= tol * max(np.abs(b).max(initial=0.0), 1e-12):
            break
    return b


def descents(gram: np.ndarray, cross: np.ndarray, lam: np.ndarray, ratio: np.ndarray, start: np.ndarray, max_iter: int = 500, tol: float = 1e-6) -> np.ndarray:
    """As descent(), of many right-hand sides (rows of ``cross``) on one Gram matrix, feature by feature for all of them; ``lam`` and ``ratio`` are columns."""
    b = start.copy()
    grad = cross - b @ gram
    diag, l1, l2 = np.diag(gram), (lam * ratio)[:, 0], (lam * (1 - ratio))[:, 0]
    rows = np.arange(len(b))
    for _ in range(max_iter):
        moved = np.zeros(len(rows))
        g, w = grad[rows], b[rows]
        for j in np.flatnonzero(diag > 0):
            old = w[:, j].copy()
            new = soft(g[:, j] + diag[j] * old, l1[rows]) / (diag[j] + l2[rows])
            step = new - old
            if step.any():
                g -= step[:, None] * gram[j]
                w[:, j] = new
                np.maximum(moved, np.abs(step), out=moved)
        grad[rows], b[rows] = g, w
        rows = rows[moved > tol * np.maximum(np.abs(w).max(axis=1, initial=0.0), 1e-12)]
        if not len(rows):
            break
    return b


def path(gram: np.ndarray, cross: np.ndarray, settings: list[tuple[float, float]], warm_start: bool = True, screen: bool = True, **more) -> np.ndarray:
    """Coefficients (settings x features) along (lambda, ratio) settings.

    The sequential strong rule leaves out features whose gradient at the last solution is below twice the penalty less the last
    one; what breaks the optimality conditions at the solution found without them comes in, until nothing does. A penalty above all gradients at
    zero gives zeros without a descent.
    """
    out, b, before = [], np.zeros(len(cross)), None
    top = np.abs(cross).max(initial=0.0)
    for lam, ratio in settings:
        l1 = lam * ratio
        if not screen:
            b = descent(gram, cross, lam, ratio, b if warm_start and before is not None else None, **more)
        elif top <= l1:
            b = np.zeros(len(cross))
        else:
            start = b if warm_start else np.zeros(len(cross))
            on = (np.abs(cross - gram @ b) >= 2 * l1 - max(top if before is None else before, l1)) | (b != 0)
            while True:
                at = np.flatnonzero(on)
                b = np.zeros(len(cross))
                b[at] = descent(gram[np.ix_(at, at)], cross[at], lam, ratio, start[at], **more)
                missed = ~on & (np.abs(cross - gram @ b) > l1 * (1 + 1e-9))
                if not missed.any():
                    break
                on, start = on | missed, b
        before = l1
        out.append(b)
    return np.array(out)


def least_squares(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Minimum-norm solution of the normal equations."""
    return np.linalg.pinv(gram, rcond=1e-10, hermitian=True) @ cross if len(cross) else np.zeros(0)


# losses: value and gradient of mean losses


def logistic_loss(w: np.ndarray, x: np.ndarray, y: np.ndarray, alpha: float = 0.0, mask: np.ndarray | None = None, weight: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Labels y are -1 and 1; w holds the coefficients and, if longer than the columns of x, the intercept."""
    n, p = x.shape
    coef = w[:p] * (mask if mask is not None else 1.0)
    z = y * (x @ coef + (w[p] if len(w) > p else 0.0))
    s = np.ones(n) if weight is None else weight
    value = (s * np.logaddexp(0, -z)).sum() / n + alpha / 2 * (coef @ coef)
    r = s * (sigmoid(z) - 1) * y
    grad = np.zeros_like(w)
    grad[:p] = x.T @ r / n + alpha * coef
    if mask is not None:
        grad[:p] *= mask
    if len(w) > p:
        grad[p] = r.sum() / n
    return float(value), grad


def multinomial_loss(w: np.ndarray, x: np.ndarray, onehot: np.ndarray, alpha: float = 0.0, mask: np.ndarray | None = None, weight: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """w is (features [+ 1]) x classes, the intercepts in the last row; mask is features x classes."""
    n, p = x.shape
    coef = w[:p] * (mask if mask is not None else 1.0)
    z = x @ coef + (w[p] if len(w) > p else 0.0)
    top = z.max(axis=1, keepdims=True)
    log_p = z - top - np.log(np.exp(z - top).sum(axis=1, keepdims=True))
    s = np.ones((n, 1)) if weight is None else weight[:, None]
    value = -(s * onehot * log_p).sum() / n + alpha / 2 * (coef**2).sum()
    r = s * (np.exp(log_p) - onehot)
    grad = np.zeros_like(w)
    grad[:p] = x.T @ r / n + alpha * coef
    if mask is not None:
        grad[:p] *= mask
    if len(w) > p:
        grad[p] = r.sum(axis=0) / n
    return float(value), grad


def poisson_loss(w: np.ndarray, x: np.ndarray, y: np.ndarray, l2: float = 0.0, weight: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    n, p = x.shape
    eta = np.clip(x @ w[:p] + (w[p] if len(w) > p else 0.0), -ETA, ETA)
    mu = np.exp(eta)
    s = np.ones(n) if weight is None else weight
    value = (s * (mu - y * eta)).sum() / n + l2 / 2 * (w[:p] @ w[:p])
    r = s * (mu - y)
    grad = np.zeros_like(w)
    grad[:p] = x.T @ r / n + l2 * w[:p]
    if len(w) > p:
        grad[p] = r.sum() / n
    return float(value), grad


def minimise(loss, w: np.ndarray, l1: float, penalised: int, max_iter: int, tol: float) -> np.ndarray:
    """The orthant-wise minimum from ``w``. Two iterates without coefficients end an L1 search: if the gradient there is within the penalty they stay zero and only
    the rest is minimised. Reaching ``max_iter`` is a RuntimeWarning."""

    def f(v, g):
        value, grad = loss(v)
        g[...] = grad
        return value

    def rest(v, g, held):
        whole = held.copy()
        whole.ravel()[penalised:] = v
        value, grad = loss(whole)
        g[...] = grad.ravel()[penalised:]
        return value

    import warnings

    more = {"epsilon": tol, "max_iterations": max_iter, "line_search": "default"}
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        try:
            w = LBFGS(orthantwise_c=l1, orthantwise_end=penalised, stop_at_zero=l1 > 0, **more).minimize(f, w)
        except AllZeroLBFGSError as zero:
            w = zero.x
            if w.size > penalised:
                w.ravel()[penalised:] = LBFGS(**more).minimize(rest, w.ravel()[penalised:], args=(w,))
            if np.abs(loss(w)[1].ravel()[:penalised]).max(initial=0.0) > l1:
                w = LBFGS(orthantwise_c=l1, orthantwise_end=penalised, **more).minimize(f, w)
    if any("iteration limit" in str(x.message) for x in said):
        warnings.warn(f"the minimiser still moves after {max_iter} iterations", RuntimeWarning, stacklevel=3)
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, classes: int, penalty: str = "l1", c: float = np.inf, intercept: bool = True, mask: np.ndarray | None = None, weight: np.ndarray | None = None, start: np.ndarray | None = None, max_iter: int = 10000, tol: float = 1e-3, multinomial: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """coef (outputs x features) and intercepts of a logistic model of labels 0 .. classes - 1; ``c`` = inf means no penalty. ``mask``: outputs x features."""
    p = x.shape[1]
    alpha = 0.0 if np.isinf(c) else 1.0 / c
    l1, l2 = (alpha, 0.0) if penalty == "l1" else (0.0, alpha)
    start = None if start is None else start.copy()
    if classes == 2 and not multinomial:
        sign = np.where(y == 1, 1.0, -1.0)
        m = None if mask is None else np.asarray(mask, float).reshape(p)
        w = np.zeros(p + intercept) if start is None else start
        if start is None and l1 and intercept:  # at this start the gradient tells whether all coefficients are zero
            w[p] = intercept_alone(np.average(y == 1, weights=weight), "logistic")
        w = minimise(lambda v: logistic_loss(v, x, sign, l2, m, weight), w, l1, p, max_iter, tol)
        coef = w[:p] * (m if m is not None else 1.0)
        return coef[None, :], w[p:] if intercept else np.zeros(1)
    onehot = np.eye(classes)[y]
    m = None if mask is None else np.asarray(mask, float).T
    w = np.zeros((p + intercept, classes)) if start is None else start
    if start is None and l1 and intercept:
        alone = intercept_alone(np.average(onehot, axis=0, weights=weight), "multinomial")
        w[p] = alone - alone.mean()
    w = minimise(lambda v: multinomial_loss(v.reshape(-1, classes), x, onehot, l2, m, weight), w, l1, p * classes, max_iter, tol)
    coef = w[:p] * (m if m is not None else 1.0)
    return coef.T, w[p] if intercept else np.zeros(classes)


def logistic_path(x: np.ndarray, y: np.ndarray, classes: int, cs: list[float], penalty: str = "l1", intercept: bool = True, warm_start: bool = True, **more) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (settings x outputs x features) and intercepts (settings x outputs) along inverse strengths ``cs``."""
    coefs, intercepts, start = [], [], None
    multi = more.get("multinomial", False) or classes > 2
    for c in cs:
        coef, b = fit_logistic(x, y, classes, penalty, c, intercept, start=start, **more)
        coefs.append(coef)
        intercepts.append(b)
        if warm_start:
            start = (np.vstack([coef.T, b[None, :]]) if intercept else coef.T.copy()) if multi else np.r_[coef[0], b] if intercept else coef[0].copy()
    return np.array(coefs), np.array(intercepts)


def fit_poisson(x: np.ndarray, y: np.ndarray, alpha: float = 1.0, ratio: float = 1.0, intercept: bool = True, weight: np.ndarray | None = None, solver: str = "lbfgs", start: np.ndarray | None = None, max_iter: int = 1000, tol: float = 1e-5) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of an elastic-net Poisson model, by the orthant-wise minimiser or by reweighted least squares with coordinate descent."""
    n, p = x.shape
    if y.max(initial=0) == y.min(initial=0):
        return np.zeros(p), (-np.inf if not y.any() else float(np.log(y[0]))) if intercept else 0.0
    if solver == "lbfgs":
        w = np.zeros(p + intercept) if start is None else start
        if intercept and start is None:
            w[p] = np.log(max(y.mean(), 1e-10))
        w = minimise(lambda v: poisson_loss(v, x, y, alpha * (1 - ratio), weight), w, alpha * ratio, p, max_iter, tol)
        return w[:p], float(w[p]) if intercept else 0.0
    if solver != "cd":
        raise ValueError(f"solver must be 'lbfgs' or 'cd', not {solver!r}")
    s = np.ones(n) if weight is None else weight
    b, b0 = (np.zeros(p), float(np.log(max(y.mean(), 1e-10))) if intercept else 0.0) if start is None else (start[:p].copy(), float(start[p]) if intercept else 0.0)
    objective = lambda v, v0: poisson_loss(np.r_[v, v0], x, y, 0.0, s)[0] + alpha * (ratio * np.abs(v).sum() + (1 - ratio) / 2 * (v @ v))
    now = objective(b, b0)
    for _ in range(max_iter):
        eta = np.clip(x @ b + b0, -ETA, ETA)
        w = np.exp(eta)
        z = eta + y / w - 1
        w = w * s
        total = w.sum()
        mx, mz = (w @ x / total, w @ z / total) if intercept else (np.zeros(p), 0.0)
        xc = x - mx
        new = descent((xc * w[:, None]).T @ xc / n, (xc * w[:, None]).T @ (z - mz) / n, alpha, ratio, b, 200, tol * 0.1)
        new0 = mz - mx @ new if intercept else 0.0
        step = 1.0
        while (then := objective(b + step * (new - b), b0 + step * (new0 - b0))) > now + 1e-12 and step > 1e-4:
            step /= 2
        move = max(np.abs(step * (new - b)).max(initial=0.0), abs(step * (new0 - b0)))
        b, b0, now = b + step * (new - b), b0 + step * (new0 - b0), then
        if move < tol:
            break
    return b, b0


def fit_family(family, x: np.ndarray, y: np.ndarray, lam: float, ratio: float, intercept: bool = True, mask: np.ndarray | None = None, start: np.ndarray | None = None, max_iter: int = 1000, tol: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (outputs x features) and intercepts of a model of any family (see ``families``) with an elastic-net penalty, on one block."""
    (n, p), k = x.shape, family.outputs
    on = 1.0 if mask is None else np.asarray(mask, float).T
    l2 = lam * (1 - ratio)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        coef = w[:p] * on
        values, r = family.terms(x @ coef + (w[p] if intercept else 0.0), y)
        grad = np.zeros_like(w)
        grad[:p] = (x.T @ r / n + l2 * coef) * on
        if intercept:
            grad[p] = r.sum(axis=0) / n
        return float(values.mean() + l2 / 2 * (coef**2).sum()), grad

    if start is None:
        start = np.zeros((p + intercept, k))
        if intercept:
            start[p] = np.where(np.isfinite(a := family.alone(family.targets(y).mean(axis=0))), a, 0.0)
    w = minimise(loss, start, lam * ratio, p * k, max_iter, tol)
    coef = (w[:p] * on).T
    return (family.settled(coef, mask) if lam == 0 else coef), w[p] if intercept else np.zeros(k)


def intercept_alone(means: np.ndarray, family: str) -> float | np.ndarray:
    """The intercept of a model without features: of the label's mean, or of the classes' shares.

    linear: the mean; logistic: the logit of the share, which is kept 1e-10 from 0 and 1; multinomial: logarithms of the shares
    (absent classes 1e-10), the largest 0; poisson: the mean's logarithm, minus infinity if there is nothing to count.
    """
    means = np.asarray(means, float)
    if family == "linear":
        return float(means)
    if family == "poisson":
        return float(np.log(means)) if means > 0 else -np.inf
    if family == "logistic":
        q = np.clip(means, 1e-10, 1 - 1e-10)
        return float(np.log(q / (1 - q)))
    q = np.log(np.maximum(means, 1e-10))
    return q - q.max()


def intercept_of_logistic(eta: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Best intercepts at fixed linear predictors ``eta`` (rows x outputs), by Newton steps; of several outputs the largest is 0."""
    if eta.shape[1] == 1:
        b = 0.0
        for _ in range(100):
            p = sigmoid(eta[:, 0] + b)
            step = np.clip((y.mean() - p.mean()) / max((p * (1 - p)).mean(), 1e-10), -2, 2)
            b += step
            if abs(step) < 1e-10:
                break
        return np.array([b])
    k = eta.shape[1]
    share = np.maximum(np.bincount(y, minlength=k) / len(y), 1e-10)
    b = np.zeros(k)
    for _ in range(1000):
        step = np.log(share) - np.log(np.maximum(softmax(eta + b).mean(axis=0), 1e-300))
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return b - b.max()


# decomposition


def nnls(gram: np.ndarray, cross: np.ndarray, max_iter: int = 0) -> np.ndarray:
    """argmin |A w - x|, w >= 0, from A'A and A'x: active sets."""
    k = len(cross)
    w, passive = np.zeros(k), np.zeros(k, bool)
    grad = cross.copy()
    for _ in range(max_iter or 10 * k + 10):
        free = np.flatnonzero(~passive)
        if not len(free) or grad[free].max() <= 1e-10 * max(1.0, np.abs(cross).max()):
            break
        passive[free[np.argmax(grad[free])]] = True
        while True:
            at = np.flatnonzero(passive)
            z = np.zeros(k)
            z[at] = np.linalg.lstsq(gram[np.ix_(at, at)], cross[at], rcond=None)[0]
            if z[at].min(initial=1.0) > 0:
                w = z
                break
            bad = at[z[at] <= 0]
            t = (w[bad] / np.maximum(w[bad] - z[bad], 1e-300)).min()
            w = w + t * (z - w)
            passive &= w > 1e-14
            w[~passive] = 0.0
            if not passive.any():
                break
        grad = cross - gram @ w
    return w


def nnls_rows(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """nnls() of many right-hand sides (rows of ``cross``) by block principal pivoting: all variables of the wrong sign change sides at once
    (one at a time where that stops helping), and rows with the same passive set share one factorisation."""
    n, k = cross.shape
    x, y, passive = np.zeros((n, k)), -cross.copy(), np.zeros((n, k), bool)
    least, tries, rows = np.full(n, k + 1), np.full(n, 3), np.arange(n)
    small = 1e-10 * np.maximum(1.0, np.abs(cross).max(axis=1, initial=0.0))[:, None]
    for _ in range(20 * k + 20):
        wrong = np.where(passive[rows], x[rows] < 0, y[rows] < -small[rows])
        count = wrong.sum(axis=1)
        rows, wrong, count = rows[count > 0], wrong[count > 0], count[count > 0]
        if not len(rows):
            return x
        better = count < least[rows]
        least[rows[better]], tries[rows] = count[better], np.where(better, 3, tries[rows] - 1)
        last = np.zeros_like(wrong)
        last[np.arange(len(rows)), k - 1 - wrong[:, ::-1].argmax(axis=1)] = True
        passive[rows] ^= np.where((tries[rows] >= 0)[:, None], wrong, last)
        kinds, of = np.unique(passive[rows], axis=0, return_inverse=True)
        order = np.argsort(of.ravel(), kind="stable")
        for i, mine in enumerate(np.split(rows[order], np.cumsum(np.bincount(of.ravel(), minlength=len(kinds)))[:-1])):
            at, off = np.flatnonzero(kinds[i]), np.flatnonzero(~kinds[i])
            x[mine] = y[mine] = 0.0
            if len(at):
                part = gram[np.ix_(at, at)]
                try:
                    solved = np.linalg.solve(np.linalg.cholesky(part).T, np.linalg.solve(np.linalg.cholesky(part), cross[np.ix_(mine, at)].T)).T
                except np.linalg.LinAlgError:
                    solved = cross[np.ix_(mine, at)] @ np.linalg.pinv(part, hermitian=True)
                x[np.ix_(mine, at)] = solved
            y[np.ix_(mine, off)] = x[np.ix_(mine, at)] @ gram[np.ix_(at, off)] - cross[np.ix_(mine, off)]
    for i in rows:  # a singular matrix can keep a row from settling
        x[i] = nnls(gram, cross[i])
    return x


def nmf(x: np.ndarray, rank: int, seed: int, loss: str = "kullback-leibler", max_iter: int = 400, tol: float = 1e-4, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """W, H >= 0 with X about WH, by multiplicative updates; ``weight`` counts rows (bootstrap multiplicities)."""
    rng = np.random.default_rng(seed)
    n, p = x.shape
    scale = np.sqrt(max(x.mean(), 1e-12) / rank)
    w, h = np.abs(rng.standard_normal((n, rank))) * scale, np.abs(rng.standard_normal((rank, p))) * scale
    r = np.ones((n, 1)) if weight is None else weight[:, None]
    tiny = 1e-12

    def error() -> float:
        wh = np.maximum(w @ h, tiny)
        if loss == "frobenius":
            return float((r * (x - wh) ** 2).sum() / 2)
        return float((r * (np.where(x > 0, x * np.log(np.maximum(x, tiny) / wh), 0.0) - x + wh)).sum())

    first = last = error()
    for i in range(max_iter):
        if loss == "frobenius":
            w *= (x @ h.T) / np.maximum(w @ (h @ h.T), tiny)
            h *= ((r * w).T @ x) / np.maximum((r * w).T @ (w @ h), tiny)
        else:
            w *= (x / np.maximum(w @ h, tiny)) @ h.T / np.maximum(h.sum(axis=1), tiny)
            h *= (r * w).T @ (x / np.maximum(w @ h, tiny)) / np.maximum((r * w).sum(axis=0)[:, None], tiny)
        if i % 10 == 9:
            now = error()
            if last - now < tol * first:
                break
            last = now
    return w, h


def nndsvd(v: np.ndarray, values: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """A start for H (components x features) from the leading right singular vectors (columns of ``v``) and values: of each pair of singular vectors the side of
    one sign, the heavier of the two. ``above`` and ``below`` are the lengths of the positive and the negative part of each left singular vector."""
    h = []
    for j, s in enumerate(values):
        plus, minus = np.maximum(v[:, j], 0), np.maximum(-v[:, j], 0)
        if j == 0:
            h.append(np.sqrt(s) * np.abs(v[:, 0]))
            continue
        a, b = above[j] * np.linalg.norm(plus), below[j] * np.linalg.norm(minus)
        side, weight = (plus, a) if a >= b else (minus, b)
        h.append(np.sqrt(s * weight) * side / max(np.linalg.norm(side), 1e-300))
    return np.array(h)


def nmf_moments(x: np.ndarray, h: np.ndarray, times: np.ndarray) -> np.ndarray:
    """What these rows, each with its best weights W for H, add to the squared error, W'X and W'W, as one flat array."""
    w = nnls_rows(h @ h.T, x @ h.T)
    t = times[:, None]
    return np.r_[(t * (x - w @ h) ** 2).sum() / 2, ((t * w).T @ x).ravel(), ((t * w).T @ w).ravel()]


def nmf_descent(h: np.ndarray, wx: np.ndarray, ww: np.ndarray, sweeps: int = 20, tol: float = 1e-10) -> np.ndarray:
    """H >= 0 that lowers the squared error at W'X and W'W: each component in turn at its minimum given the others."""
    h = h.copy()
    for _ in range(sweeps):
        moved = 0.0
        for j in np.flatnonzero(np.diag(ww) > 1e-12):
            new = np.maximum(0.0, h[j] + (wx[j] - ww[j] @ h) / ww[j, j])
            moved = max(moved, np.abs(new - h[j]).max(initial=0.0))
            h[j] = new
        if moved <= tol * max(np.abs(h).max(initial=0.0), 1e-300):
            break
    return h


def nmf_cd(x: np.ndarray, h: np.ndarray, weight: np.ndarray, max_iter: int = 400, tol: float = 1e-4) -> np.ndarray:
    """H of the squared error's factorisation from a start, alternating both exact steps; ``weight`` counts rows."""
    first = last = None
    for _ in range(max_iter):
        s = nmf_moments(x, h, weight)
        if last is not None and last - s[0] < tol * first:
            break
        first, last = s[0] if first is None else first, s[0]
        h = nmf_descent(h, s[1 : 1 + h.size].reshape(h.shape), s[1 + h.size :].reshape(len(h), len(h)))
    return h


def nmf_weights(x: np.ndarray, h: np.ndarray, loss: str, steps: int) -> np.ndarray:
    """W >= 0 with X about WH for a given H, by ``steps`` multiplicative updates from equal weights that keep each row's sum."""
    tiny = 1e-12
    w = np.repeat(x.sum(axis=1, keepdims=True) / max(h.sum(), tiny), len(h), axis=1)
    for _ in range(steps):
        if loss == "frobenius":
            w *= (x @ h.T) / np.maximum(w @ (h @ h.T), tiny)
        else:
            w *= (x / np.maximum(w @ h, tiny)) @ h.T / np.maximum(h.sum(axis=1), tiny)
    return w


def nmf_sums(x: np.ndarray, w: np.ndarray, h: np.ndarray, times: np.ndarray, loss: str) -> np.ndarray:
    """What these rows add to the error and to the numerator and denominator of H's update, as one flat array."""
    tiny, r = 1e-12, times[:, None]
    wh = np.maximum(w @ h, tiny)
    if loss == "frobenius":
        error, above, below = (r * (x - wh) ** 2).sum() / 2, (r * w).T @ x, (r * w).T @ wh
    else:
        error = (r * (np.where(x > 0, x * np.log(np.maximum(x, tiny) / wh), 0.0) - x + wh)).sum()
        above, below = (r * w).T @ (x / wh), np.repeat((r * w).sum(axis=0)[:, None], x.shape[1], axis=1)
    return np.r_[error, above.ravel(), below.ravel()]


def dissimilarity(a: np.ndarray, b: np.ndarray) -> float:
    """1 - mean best cosine between the rows of two bases."""
    unit = lambda h: h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-300)
    c = unit(a) @ unit(b).T
    return float(1 - (c.max(axis=0).sum() + c.max(axis=1).sum()) / (2 * len(a)))


def dbscan(x: np.ndarray, eps: float = 0.5, min_samples: int = 1) -> np.ndarray:
    """Cluster of each row, -1 for noise; a border row goes to the smallest neighbouring cluster."""
    n = len(x)
    near = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * x @ x.T, 0)) <= eps
    core = near.sum(axis=1) >= min_samples
    label = np.full(n, -1)
    k = 0
    for i in range(n):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = k
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                    label[j] = k
                    todo.append(j)
            k += 1
    for i in np.flatnonzero(~core):
        own = label[near[i] & core]
        if len(own):
            label[i] = own.min()
    return label
