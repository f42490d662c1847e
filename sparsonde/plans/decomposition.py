"""Column subset selection (CUR) and non-negative matrix factorisation, each alone and as its stable variant."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparsonde.operators import frame as fr
from sparsonde.operators import kernels, stability, suffstats
from sparsonde.operators.resample import M, hash_array, multiplicities, seed_of, with_row_id

from .linear import Params


def right_singular_vectors(gram: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` right singular vectors (columns) from X'X; the largest entry of each is positive."""
    value, vector = np.linalg.eigh(gram)
    v = vector[:, np.argsort(-value, kind="stable")[:k]]
    return v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])


#: The tree of triangular factors has at most FAN_IN squared, FAN_IN and one node on its levels.
FAN_IN = 32


def _triangle(df: DataFrame, features: Sequence[str], right: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of X ``right``: every task factorises its own rows, then triangles are stacked and factorised again, level by level of a tree; only triangles move."""
    k = right.shape[1]

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, k))
        for batch in batches:
            r = np.linalg.qr(np.vstack([r, suffstats.matrix(batch, features)[:, 1:] @ right]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["node", "r"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for node, raw in zip(batch.column("node").to_pylist(), batch.column("r").to_pylist(), strict=True):
                held[node] = np.linalg.qr(np.vstack([held.get(node, np.zeros((0, k))), np.frombuffer(raw).reshape(-1, k)]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([r.tobytes() for r in held.values()], pa.binary())], ["node", "r"])

    level = df.select(*features).mapInArrow(leaf, "node long, r binary")
    for left in (FAN_IN**2, FAN_IN, 1):
        level = level.withColumn("node", F.col("node") % left).repartition("node").mapInArrow(join, "node long, r binary")
    raw = [bytes(x["r"]) for x in level.collect()]  # one triangle
    return np.linalg.qr(np.vstack([np.frombuffer(x).reshape(-1, k) for x in raw] or [np.zeros((k, k))]), mode="r")


def _through(df: DataFrame, features: Sequence[str], right: np.ndarray) -> np.ndarray:
    """X' X ``right``, one aggregate of as many numbers as ``right`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = np.zeros(right.shape)
        for batch in batches:
            x = suffstats.matrix(batch, features)[:, 1:]
            total += x.T @ (x @ right)
        return {0: total.ravel()}

    return suffstats.summed(df.select(*features), run)[0].reshape(right.shape)


def range_svd(df: DataFrame, features: Sequence[str], k: int, n_iter: int = 5, seed: int = 0, oversampling: int = 10, tol: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` right singular vectors (columns) and singular values of the rows of ``features``, by a randomised range finder.

    A random sketch of k + oversampling columns goes through X'X in ``n_iter`` power steps, one aggregate each, with its columns made
    orthonormal between them (and no more once they turn by less than ``tol``); the tall X times it is factorised by a tree of QR decompositions over
    the partitions, and its triangle gives the small factorisation. No matrix of features by features is made. The largest entry of each vector is positive.
    """
    p = len(features)
    width = min(p, k + oversampling)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((p, width)))[0]
    for _ in range(n_iter):
        turned = np.linalg.qr(_through(df, features, q))[0]
        still = np.linalg.norm(turned - q @ (q.T @ turned)) <= tol
        q = turned
        if still:
            break
    q = np.linalg.qr(_through(df, features, q))[0]  # the row space the sketch has found
    _, values, vt = np.linalg.svd(_triangle(df, features, q))
    v = (q @ vt.T)[:, :k]
    return v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1), values[:k]


def singular_vectors(df: DataFrame, features: Sequence[str], k: int, algorithm: str = "randomized", n_iter: int = 5, tol: float = 0.0, seed: int = 0) -> np.ndarray:
    """The first ``k`` right singular vectors: 'randomized' by ``range_svd``; 'arpack', the exact way, by the eigenvectors of X'X."""
    if algorithm == "arpack":
        return right_singular_vectors(suffstats.gram_matrix(df, features), k)
    return range_svd(df, features, k, n_iter, seed, tol=tol)[0]


def leverage(v: np.ndarray) -> np.ndarray:
    """Mean squared entry of each column's row in ``v`` (columns x k); sums to 1."""
    return (v**2).sum(axis=1) / v.shape[1]


def column_select(v: np.ndarray, c: float, seed: int, boot: int = 0, leverage_sort: bool = False) -> np.ndarray:
    """Indices of columns, each drawn with probability min(1, c * leverage), by ascending leverage if asked for."""
    score = leverage(v)
    u = hash_array(np.arange(len(score)), boot * 1009 + v.shape[1], seed) / M
    at = np.flatnonzero(u < np.minimum(1.0, c * score))
    return at[np.argsort(score[at], kind="stable")] if leverage_sort else at


def check_ranks(max_k: int, ks=None, cs=None) -> tuple[list[int], list[float]]:
    """Ranks (1 .. max_k by default) and expected column counts (rank + 20), as lists of one length."""
    ks = list(range(1, max_k + 1)) if ks is None else [ks] if np.isscalar(ks) else list(ks)
    if any(k < 1 or k > max_k for k in ks):
        raise ValueError(f"ranks must lie within 1 and {max_k}")
    cs = [k + 20 for k in ks] if cs is None else [cs] * len(ks) if np.isscalar(cs) else list(cs)
    if len(cs) != len(ks):
        raise ValueError("ks and cs differ in length")
    if any(c < 1 for c in cs):
        raise ValueError("expected column counts must be 1 or more")
    return ks, cs


class ColumnModel:
    def __init__(self, features: Sequence[str], at: Sequence[int]) -> None:
        self.features, self.column_indices_ = list(features), [int(i) for i in at]
        self.columns_ = [self.features[i] for i in self.column_indices_]

    def transform(self, df: DataFrame) -> DataFrame:
        """The chosen columns: the scan reads no others."""
        return df.select(*self.columns_)


class ColumnSubset(Params):
    """Columns drawn by their leverage in the first max_k singular vectors."""

    def __init__(self, max_k, algorithm="randomized", n_iter=5, tol=0.0, random_state=None) -> None:
        if algorithm not in ("randomized", "arpack"):
            raise ValueError(f"unknown algorithm {algorithm!r}")
        self.max_k, self.algorithm, self.n_iter, self.tol, self.random_state = max_k, algorithm, n_iter, tol, random_state

    def fit(self, df: DataFrame, features: Sequence[str], c: float | None = None) -> ColumnModel:
        fr.check(df, features, None)
        if self.max_k > len(features):
            raise ValueError("max_k is larger than the number of columns")
        seed = seed_of(self.random_state)
        v = singular_vectors(df, list(features), self.max_k, self.algorithm, self.n_iter, self.tol, seed)
        return ColumnModel(features, column_select(v, self.max_k + 20 if c is None else c, seed, leverage_sort=True))

    def fit_transform(self, df: DataFrame, features: Sequence[str], c: float | None = None) -> DataFrame:
        return self.fit(df, features, c).transform(df)


class StableColumns(Params):
    """Columns that enough resamples agree on, over all ranks. One pass gives every resample's Gram matrix."""

    def __init__(self, n_boots, max_k, boots_frac, stability_selection=1.0, algorithm="randomized", n_iter=5, tol=0.0, random_state=None) -> None:
        self.n_boots, self.max_k, self.boots_frac, self.stability_selection, self.algorithm, self.n_iter, self.tol, self.random_state = n_boots, max_k, boots_frac, stability_selection, algorithm, n_iter, tol, random_state
        self.limit = stability.threshold(stability_selection, n_boots)

    def fit(self, df: DataFrame, features: Sequence[str], ks=None, cs=None, stratify: str | None = None, id_col: str | None = None) -> ColumnModel:
        features = list(features)
        fr.check(df, features, None)
        ks, cs = check_ranks(self.max_k, ks, cs)
        seed = seed_of(self.random_state)
        if self.boots_frac == 1:
            grams = dict.fromkeys(range(self.n_boots), suffstats.gram_matrix(df, features))
        else:
            if id_col is None:
                df, id_col = with_row_id(df, features), "row_id"
            p = len(features)
            plain = fr.Stats(0, np.zeros(p), np.ones(p), 0.0, 1.0, 0.0, 0.0)
            held = fr.FeatureFrame(df.withColumn("one__", F.lit(1.0)), features, "one__", id_col)
            rows = suffstats.boot_grams(held, plain, {"cur": (self.n_boots, self.boots_frac, seed)}, stratify).collect()  # boots * (p + 2)^2 numbers
            grams = {r["boot"]: suffstats.parsed(r["train"])[1:-1, 1:-1] for r in rows}
        drawn = [(b, k, int(j)) for b, g in grams.items() for k, c in zip(ks, cs, strict=True) for j in column_select(right_singular_vectors(g, k), c, seed, b)]
        flags = df.sparkSession.createDataFrame(drawn, "boot int, k int, j int")
        return ColumnModel(features, sorted(r["j"] for r in chosen_columns(flags, self.limit).collect()))

    def fit_transform(self, df: DataFrame, features: Sequence[str], **more) -> DataFrame:
        return self.fit(df, features, **more).transform(df)


def chosen_columns(flags: DataFrame, limit: int) -> DataFrame:
    """(j): columns drawn in ``limit`` boots or more at any rank. ``flags``: boot, k, j."""
    return flags.groupBy("k", "j").agg(F.count("*").alias("n")).filter(F.col("n") >= limit).select("j").distinct()


def rank_list(ranks, p: int) -> list[int]:
    """None: 2 .. p; an integer: 2 .. it; else the ranks given."""
    if ranks is None:
        return list(range(2, p + 1))
    if isinstance(ranks, bool) or not isinstance(ranks, int | np.integer | list | tuple | range | np.ndarray):
        raise ValueError(f"ranks must be an integer or a sequence, not {ranks!r}")
    return list(range(2, int(ranks) + 1)) if isinstance(ranks, int | np.integer) else [int(k) for k in ranks]


class NMFModel:
    """Bases (components x features); rows are solved for by non-negative least squares."""

    def __init__(self, features: Sequence[str], components: np.ndarray, **more) -> None:
        self.features, self.components_ = list(features), components
        for k, v in more.items():
            setattr(self, k, v)

    def transform(self, df: DataFrame, output: str = "weights", error: str | None = None, solve: Callable | None = None) -> DataFrame:
        """Adds each row's weights and, if named, its squared reconstruction error. Rows are solved for together, or one by one by ``solve(gram, cross)``."""
        if missing := set(self.features) - set(df.columns):
            raise ValueError(f"features are missing: {sorted(missing)}")
        h, names = self.components_, self.features
        gram = h @ h.T

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = suffstats.matrix(batch, names)[:, 1:]
                w = kernels.nnls_rows(gram, x @ h.T) if solve is None else np.array([solve(gram, c) for c in x @ h.T]).reshape(len(x), len(h))
                arrays = [*batch.columns, pa.array(list(w), pa.list_(pa.float64()))]
                if error:
                    arrays.append(pa.array(((x - w @ h) ** 2).sum(axis=1)))
                yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, output, *([error] if error else [])])

        more = [T.StructField(output, T.ArrayType(T.DoubleType())), *([T.StructField(error, T.DoubleType())] if error else [])]
        return df.mapInArrow(run, T.StructType([*df.schema.fields, *more]))

    def inverse_transform(self, df: DataFrame, weights: str = "weights", output: str = "reconstructed") -> DataFrame:
        """The rows that the weights stand for, as an array column."""
        columns = [F.aggregate(F.zip_with(F.col(weights), F.array(*[F.lit(float(v)) for v in col]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for col in self.components_.T]
        return df.withColumn(output, F.array(*columns))


def unit_bases(bases: np.ndarray) -> np.ndarray:
    """The bases that aren't 0, of length 1."""
    bases = bases[bases.any(axis=1)]
    return bases / np.linalg.norm(bases, axis=1, keepdims=True)


def consensus(bases: np.ndarray, labels: np.ndarray, middle: Callable | None = None) -> np.ndarray:
    """The mean (or ``middle``) of each cluster's bases, of length 1, by label; -1 is no cluster."""
    means = np.array([(middle or (lambda h: h.mean(axis=0)))(bases[labels == c]) for c in sorted(set(labels.tolist()) - {-1})]).reshape(-1, bases.shape[1])
    return means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-300)


def choose_rank(apart: Sequence[float], ranks: Sequence[int]) -> int:
    """The rank whose bases agree best; of equal ones the first."""
    return ranks[int(np.argmin(apart))]


class StableNMF(Params):
    """Bases that recur over bootstraps: factorise resamples at each rank, choose the rank whose bases agree best, cluster and average them.

    ``nmf(x, rank, seed, weight)``, ``cluster(bases)``, ``nnreg(gram, cross)`` and ``cons_meth(members)`` can be replaced. A matrix of
    up to ``block_mb`` goes to the tasks as one block. A larger one stays distributed: each update of H, for all boots and ranks, is
    one aggregate, in which every row solves for its own weights. Resamples are the same draws with replacement at every size.
    """

    def __init__(self, n_boots=10, ranks=None, nmf_init="random", nmf_solver="mu", nmf_beta_loss="kullback-leibler", nmf_tol=1e-4, nmf_max_iter=400, db_eps=0.5, db_min_samples=None, db_metric="euclidean", use_dissimilarity=True, random_state=None, logger=None, nmf=None, cluster=None, nnreg=None, cons_meth=None, block_mb=256, inner=30) -> None:
        for k in self.__init__.__code__.co_varnames[1 : self.__init__.__code__.co_argcount]:
            setattr(self, k, locals()[k])
        if use_dissimilarity and n_boots == 1:
            raise ValueError("dissimilarity needs more than one boot")
        if nmf_beta_loss not in ("kullback-leibler", "frobenius") or nmf_solver not in ("mu", "cd") or nmf_init not in ("random", "nndsvd") or db_metric != "euclidean":
            raise ValueError("supported: solvers 'mu' and 'cd', inits 'random' and 'nndsvd', losses 'kullback-leibler' and 'frobenius', metric 'euclidean'")
        if nmf_solver == "cd" and nmf_beta_loss != "frobenius":
            raise ValueError("solver 'cd' needs the loss 'frobenius'")
        if nmf_init == "nndsvd" and nmf_solver != "cd":
            raise ValueError("the start 'nndsvd' has zeros, which solver 'mu' would keep: use 'cd'")

    def fit(self, df: DataFrame, features: Sequence[str], id_col: str | None = None) -> NMFModel:
        features = list(features)
        log = self.logger or logging.getLogger(__name__)
        fr.check(df, features, None)
        fr.check_non_negative(df, features)
        ranks = rank_list(self.ranks, len(features))
        seed = seed_of(self.random_state)
        if df.count() * len(features) * 8 > self.block_mb * 2**20:
            of = self._distributed(df, features, id_col, ranks, seed)
        else:
            of = self._block(df, features, id_col, ranks, seed)
        apart = None
        if self.use_dissimilarity:
            b = self.n_boots
            apart = [2 * sum(kernels.dissimilarity(of[k][i], of[k][j]) for i in range(b) for j in range(i)) / (b * (b - 1)) for k in ranks]
            bases = np.vstack(of[choose_rank(apart, ranks)])
        else:
            bases = np.vstack([h for k in ranks for h in of[k]])
        bases = unit_bases(bases)
        least = self.db_min_samples or max(self.n_boots // 2, 1)
        labels = (self.cluster or (lambda h: kernels.dbscan(h, self.db_eps, least)))(bases)
        means = consensus(bases, np.asarray(labels), self.cons_meth)
        log.info("%d bases in %d clusters", len(bases), len(means))
        return NMFModel(features, means, bases_samples_=bases, bases_samples_labels_=labels, dissimilarity_=apart, ranks_=ranks)

    def _starts(self, df: DataFrame, features: list[str], models: list[tuple[int, int]], mean: float, seed: int) -> list[np.ndarray]:
        """H at the start of each (rank, boot): random, or for all boots of a rank from the whole table's singular vectors."""
        p = len(features)
        if self.nmf_init == "random":
            return [np.abs(np.random.default_rng(seed + b * 100 + k).standard_normal((k, p))) * np.sqrt(max(mean, 1e-12) / k) for k, b in models]
        v, values = range_svd(df, features, min(max(k for k, _ in models), p), n_iter=7, seed=seed)

        def run(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
            total = np.zeros((2, len(values)))
            for batch in batches:
                u = suffstats.matrix(batch, features)[:, 1:] @ v / np.maximum(values, 1e-300)
                total += (np.maximum(u, 0) ** 2).sum(axis=0), (np.maximum(-u, 0) ** 2).sum(axis=0)
            return {0: total.ravel()}

        above, below = np.sqrt(suffstats.summed(df.select(*features), run)[0].reshape(2, -1))
        base = kernels.nndsvd(v, values, above, below)
        return [np.vstack([base[:k], np.full((max(k - len(base), 0), p), 1e-3)]) for k, _ in models]

    def _block(self, df: DataFrame, features: list[str], id_col: str | None, ranks: list[int], seed: int) -> dict[int, list[np.ndarray]]:
        """The bases of each rank's boots, a task per rank and boot."""
        rows = with_row_id(df.select(*([id_col] if id_col else []), *features), [id_col] if id_col else features, "draw__").toArrow().sort_by("draw__")
        x = np.column_stack([rows[c].cast(pa.float64()).to_numpy() for c in features])
        shared = df.sparkSession.sparkContext.broadcast(x)
        loss, steps, tol = self.nmf_beta_loss, self.nmf_max_iter, self.nmf_tol
        factor = self.nmf or (lambda x, rank, seed, weight: kernels.nmf(x, rank, seed, loss, steps, tol, weight)[1])
        models = [(k, b) for k in ranks for b in range(self.n_boots)]
        starts = dict(zip(models, self._starts(df, features, models, float(x.mean()), seed), strict=True)) if self.nmf_solver == "cd" and not self.nmf else None

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x = shared.value
            for f in frames:
                for r in f.itertuples():
                    times = np.bincount(hash_array(np.arange(len(x)), r.boot, seed) % len(x), minlength=len(x))
                    some, counts = x[times > 0], times[times > 0].astype(float)
                    if starts is not None:
                        h = kernels.nmf_cd(some, starts[r.rank, r.boot], counts, steps, tol)
                    else:
                        h = factor(some, r.rank, seed + r.boot * 100 + r.rank, counts)
                    yield pd.DataFrame({"rank": r.rank, "boot": r.boot, "comp": np.arange(len(h)), "basis": list(h)})

        tasks = df.sparkSession.createDataFrame([(b, k) for k in ranks for b in range(self.n_boots)], "boot int, rank int").repartition(len(ranks) * self.n_boots, "boot", "rank")
        found = tasks.mapInPandas(run, "rank int, boot int, comp int, basis array<double>").toPandas().sort_values(["rank", "boot", "comp"])
        return {k: [np.array(g["basis"].tolist()) for _, g in f.groupby("boot")] for k, f in found.groupby("rank")}

    def _distributed(self, df: DataFrame, features: list[str], id_col: str | None, ranks: list[int], seed: int) -> dict[int, list[np.ndarray]]:
        """The same of rows that stay where they are."""
        if self.nmf:
            raise ValueError(f"a factorisation of one's own takes a matrix of at most block_mb={self.block_mb}")
        numbered = with_row_id(df.select(*([id_col] if id_col else []), *features), [id_col] if id_col else features, "draw__").select("draw__", *features)
        counts = multiplicities(numbered, "draw__", self.n_boots, seed).groupBy("row_id").agg(*[F.sum(F.when(F.col("boot") == b, F.col("times")).otherwise(0)).alias(f"times{b}__") for b in range(self.n_boots)])
        held = numbered.join(counts, numbered["draw__"] == counts["row_id"]).drop("draw__", "row_id").persist()  # rows that no boot draws are of no use
        loss, steps, p = self.nmf_beta_loss, self.inner, len(features)
        models = [(k, b) for k in ranks for b in range(self.n_boots)]
        mean = numbered.agg(F.avg(sum(F.col(c) for c in features))).first()[0] / p
        bases = dict(enumerate(self._starts(df, features, models, mean, seed)))
        by_descent = self.nmf_solver == "cd"
        first: dict[int, float] = {}
        last: dict[int, float] = {}
        active = set(bases)
        for step in range(self.nmf_max_iter):
            now = {i: bases[i] for i in active}

            def run(batches: Iterator[pa.RecordBatch], now=now) -> dict[int, np.ndarray]:
                sums = {i: np.zeros(1 + h.size + (len(h) ** 2 if by_descent else h.size)) for i, h in now.items()}
                for batch in batches:
                    x = suffstats.matrix(batch, features)[:, 1:]
                    for i, h in now.items():
                        times = batch.column(f"times{models[i][1]}__").to_numpy()
                        at = times > 0
                        if by_descent:
                            sums[i] += kernels.nmf_moments(x[at], h, times[at])
                            continue
                        sums[i] += kernels.nmf_sums(x[at], kernels.nmf_weights(x[at], h, loss, steps), h, times[at], loss)
                return sums

            for i, s in suffstats.summed(held, run).items():
                if by_descent:
                    if last.get(i, np.inf) - s[0] < self.nmf_tol * first.setdefault(i, s[0]):
                        active.discard(i)
                        continue
                    h, last[i] = bases[i], s[0]
                    bases[i] = kernels.nmf_descent(h, s[1 : 1 + h.size].reshape(h.shape), s[1 + h.size :].reshape(len(h), len(h)))
                    continue
                above, below = s[1:].reshape(2, *bases[i].shape)
                bases[i] = bases[i] * above / np.maximum(below, 1e-12)
                if step % 10 == 0:
                    first.setdefault(i, s[0])
                    if last.get(i, np.inf) - s[0] < self.nmf_tol * first[i]:
                        active.discard(i)
                    last[i] = s[0]
            if not active:
                break
        held.unpersist()
        if active:
            (self.logger or logging.getLogger(__name__)).warning("%d of %d factorisations still move after %d steps", len(active), len(models), self.nmf_max_iter)
        return {k: [bases[i] for i, m in enumerate(models) if m[0] == k] for k in ranks}

    def fit_transform(self, df: DataFrame, features: Sequence[str], **more) -> DataFrame:
        return self.fit(df, features).transform(df, solve=self.nnreg, **more)
