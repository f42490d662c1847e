"""Augmented Gram matrices of all resamples in one pass: with v = (1, features, label), the sum of v v' per boot and side."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frame import FeatureFrame, Stats
from .resample import cutoffs, hash_array


def strata_of(batch: pa.RecordBatch, stratum: str) -> tuple[list, np.ndarray]:
    """The distinct strata of a batch, and the place of each row's among them."""
    found = batch.column(stratum).dictionary_encode(null_encoding="encode")
    return found.dictionary.to_pylist(), found.indices.to_numpy()


def matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([np.ones(batch.num_rows), *[batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names]]) if names else np.ones((batch.num_rows, 1))


def summed(df: DataFrame, sums: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Arrays by key, added up over all tasks: ``sums`` gives those of a task's batches. Only the arrays move, one of each key and task."""
    table = lambda found: pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([s.tobytes() for s in found.values()], pa.binary())], ["key", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("key").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(raw)
        yield table(total)

    rows = df.mapInArrow(lambda batches: iter([table(sums(batches))]), "key long, sums binary").repartition("key").mapInArrow(add, "key long, sums binary").collect()  # a row per key
    return {r["key"]: np.frombuffer(bytes(r["sums"])) for r in rows}


def mean_loss(df: DataFrame, names: Sequence[str], loss) -> tuple[float, np.ndarray]:
    """Value and gradient of a mean loss over all rows: ``loss(matrix of names)`` gives those of a batch; tasks weigh them by rows and Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for batch in batches:
            if batch.num_rows:
                value, grad = loss(matrix(batch, names)[:, 1:])
                n, total = n + batch.num_rows, total + batch.num_rows * np.r_[value, grad.ravel()]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), n))], ["k", "total", "n"])

    rows = df.select(*names).mapInArrow(run, "k long, total double, n long").groupBy("k").agg((F.sum("total") / F.sum("n")).alias("mean")).orderBy("k").collect()  # a row per coefficient
    return rows[0]["mean"], np.array([r["mean"] for r in rows[1:]])


def boot_grams(frame: FeatureFrame, stats: Stats, families: dict[str, tuple[int, float, int]], stratum: str | None = None) -> DataFrame:
    """(family, boot, train, test): Gram matrices (float64 bytes) of each family's boots; ``families``: name -> (boots, train fraction, seed).

    Features and label are standardised with ``stats`` on the way in, which keeps the sums well conditioned. A task sums all
    boots of its rows by matrix products; only boots * (p + 2)^2 numbers per task are shuffled.
    """
    names = [*frame.features, frame.label]
    cuts: dict[str, dict] = {}
    for family, (boots, fraction, seed) in families.items():
        rows = cutoffs(frame.df, frame.id_col, boots, fraction, seed, stratum).collect()  # a row per boot and stratum
        cuts[family] = {(r["boot"], r["stratum"] if stratum else None): (r["cut_h"], r["cut_id"]) for r in rows}
    mean, std = np.r_[stats.mean, stats.y_mean], np.r_[stats.std, stats.y_std]
    width = len(names) + 1
    id_col = frame.id_col

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(f, b): [np.zeros((width, width)), np.zeros((width, width))] for f, (boots, _, _) in families.items() for b in range(boots)}
        for batch in batches:
            v = matrix(batch, names)
            v[:, 1:] = (v[:, 1:] - mean) / std
            ids = batch.column(id_col).cast(pa.int64()).to_numpy()
            strata, place = strata_of(batch, stratum) if stratum else (None, None)
            for f, (boots, _, seed) in families.items():
                for b in range(boots):
                    h = hash_array(ids, b, seed)
                    if strata is None:
                        ch, ci = cuts[f].get((b, None), (-1, -1))
                    else:
                        ch, ci = np.array([cuts[f].get((b, s), (-1, -1)) for s in strata]).T[:, place]
                    test = (h < ch) | ((h == ch) & (ids <= ci))
                    sums[f, b][0] += v[~test].T @ v[~test]
                    sums[f, b][1] += v[test].T @ v[test]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums], pa.int32()), pa.array([s[0].tobytes() for s in sums.values()], pa.binary()), pa.array([s[1].tobytes() for s in sums.values()], pa.binary())], ["family", "boot", "train", "test"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                x = [np.frombuffer(r[s]) for s in ("train", "test")]
                k = (r["family"], r["boot"])
                sums[k] = [a + b for a, b in zip(sums[k], x, strict=True)] if k in sums else x
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array([s[0].tobytes() for s in sums.values()], pa.binary()), pa.array([s[1].tobytes() for s in sums.values()], pa.binary())], ["family", "boot", "train", "test"])

    schema = "family string, boot int, train binary, test binary"
    some = frame.df.select(id_col, *names, *([stratum] if stratum and stratum not in names else []))
    return some.mapInArrow(run, schema).repartition("family", "boot").mapInArrow(add, schema)


def gram_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """X'X of the columns (not centred): a matrix product per task, summed by Spark."""
    p = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((p, p))
        for batch in batches:
            x = matrix(batch, columns)[:, 1:]
            out += x.T @ x
        i, j = np.indices((p, p))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(out.ravel())], ["i", "j", "v"])

    rows = df.select(*columns).mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((p, p))
    out[rows["i"].to_numpy(), rows["j"].to_numpy()] = rows["v"].to_numpy()
    return out


def parsed(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw)
    k = int(round(np.sqrt(len(x))))
    return x.reshape(k, k)


def solve_parts(a: np.ndarray, intercept: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of an augmented Gram: X'X / n and X'y / n (centred if there is an intercept), the means of X and of y."""
    n = max(a[0, 0], 1.0)
    m, ym = a[0, 1:-1] / n, a[0, -1] / n
    g, c = a[1:-1, 1:-1] / n, a[1:-1, -1] / n
    if intercept:
        return g - np.outer(m, m), c - m * ym, m, ym
    return g, c, np.zeros_like(m), 0.0


def residual(a: np.ndarray, coef: np.ndarray, intercept: float) -> tuple[float, float, float]:
    """Rows, residual and total sums of squares of a linear model on an augmented Gram's rows."""
    u = np.r_[-intercept, -coef, 1.0]
    n = a[0, 0]
    return n, max(float(u @ a @ u), 0.0), float(a[-1, -1] - a[0, -1] ** 2 / max(n, 1.0))
