"""Where a model's features are: columns, one array column, or sparse (indices, values) arrays. Rows of a batch as a block with the few products that fits need."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import AbstractContextManager, contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparsonde.functions import columns as fn

#: Columns of the right-hand side that a sparse product takes at a time.
ACROSS = 32
#: Numbers of a dense block of rows: what is worked on at once doesn't grow with the rows of a batch.
BLOCK = 1 << 20


class Dense:
    """Rows as a matrix."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.n = x, len(x)

    def times(self, w: np.ndarray) -> np.ndarray:
        """X w, for w of features x columns."""
        return self.x @ w

    def transposed(self, r: np.ndarray) -> np.ndarray:
        """X' r, for r of rows x columns."""
        return self.x.T @ r

    def dense(self) -> np.ndarray:
        return self.x

    def columns(self, at: np.ndarray) -> np.ndarray:
        return self.x[:, at]

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each feature the sum and the sum of squares."""
        return self.x.sum(axis=0), (self.x**2).sum(axis=0)

    def row_bound(self) -> np.ndarray:
        """Sums over rows of |x_j| * sum_k |x_k|: X'X is at most the diagonal matrix of these."""
        a = np.abs(self.x)
        return a.T @ a.sum(axis=1)

    def slice(self, first: int, last: int) -> Dense:
        return Dense(self.x[first:last])


class CSR:
    """Rows as runs of (feature, value) entries; a feature may come twice in a row, then its values add up."""

    def __init__(self, at: np.ndarray, feature: np.ndarray, value: np.ndarray, p: int) -> None:
        self.at, self.feature, self.value, self.p, self.n = at, feature, value, p, len(at) - 1
        self._by_feature: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @staticmethod
    def _runs(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, starts, axis=0) if len(starts) else x[:0]

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, w.shape[1]))
        full = np.flatnonzero(np.diff(self.at))
        for c in range(0, w.shape[1], ACROSS):
            out[full, c : c + ACROSS] = self._runs(w[self.feature, c : c + ACROSS] * self.value[:, None], self.at[full])
        return out

    def transposed(self, r: np.ndarray) -> np.ndarray:
        if self._by_feature is None:
            order = np.argsort(self.feature, kind="stable")
            found, starts = np.unique(self.feature[order], return_index=True)
            self._by_feature = order, found, starts
        order, found, starts = self._by_feature
        row = np.repeat(np.arange(self.n), np.diff(self.at))[order]
        out = np.zeros((self.p, r.shape[1]))
        for c in range(0, r.shape[1], ACROSS):
            out[found, c : c + ACROSS] = self._runs(r[row, c : c + ACROSS] * self.value[order][:, None], starts)
        return out

    def dense(self) -> np.ndarray:
        return self.columns(np.arange(self.p))

    def columns(self, at: np.ndarray) -> np.ndarray:
        """Some features of all rows, as a matrix."""
        place = np.full(self.p, -1)
        place[at] = np.arange(len(at))
        here = place[self.feature]
        on = here >= 0
        out = np.zeros((self.n, len(at)))
        np.add.at(out, (np.repeat(np.arange(self.n), np.diff(self.at))[on], here[on]), self.value[on])
        return out

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        """The feature and value of each (row, feature), once."""
        key, place = np.unique(np.repeat(np.arange(self.n), np.diff(self.at)) * self.p + self.feature, return_inverse=True)
        return key, np.bincount(place, self.value, len(key))

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        key, v = self._merged()
        return np.bincount(key % self.p, v, self.p), np.bincount(key % self.p, v**2, self.p)

    def row_bound(self) -> np.ndarray:
        key, v = self._merged()
        a = np.abs(v)
        return np.bincount(key % self.p, a * np.bincount(key // self.p, a, self.n)[key // self.p], self.p)

    def slice(self, first: int, last: int) -> CSR:
        at = self.at[first : last + 1]
        return CSR(at - at[0], self.feature[at[0] : at[-1]], self.value[at[0] : at[-1]], self.p)


@dataclass
class Design:
    """``names``: a column each; or ``vector``: one array column of ``p`` numbers; or ``indices`` (from 0, below ``p``) and ``values``, two array columns.

    ``mean`` and ``std`` are taken off and divided by as rows are read. Taking a mean off would fill a sparse row, so there it must be 0.
    """

    names: Sequence[str] = ()
    vector: str | None = None
    indices: str | None = None
    values: str | None = None
    p: int = 0
    mean: np.ndarray | None = field(default=None, repr=False)
    std: np.ndarray | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        self.names = list(self.names)
        self.p = self.p or len(self.names)
        if self.p < 1:
            raise ValueError("the number of features is missing")

    @property
    def sparse(self) -> bool:
        return self.indices is not None

    @property
    def columns(self) -> list[str]:
        return [self.indices, self.values] if self.sparse else [self.vector] if self.vector else list(self.names)

    def scaled(self, mean: np.ndarray | None, std: np.ndarray) -> Design:
        if self.sparse and mean is not None and np.any(mean):
            raise ValueError("sparse features can't be centred: use fit_intercept=False or standardize=False")
        return Design(self.names, self.vector, self.indices, self.values, self.p, mean, std)

    def check(self, df: DataFrame) -> None:
        """Raises ValueError if an array has another length, an index lies outside, or a number is null or not finite."""
        if not (self.sparse or self.vector):
            return
        v = F.col(self.values if self.sparse else self.vector)
        bad = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
        if self.sparse:
            i = F.col(self.indices)
            bad = bad | i.isNull() | (F.size(i) != F.size(v)) | F.exists(i, lambda x: x.isNull() | (x < 0) | (x >= self.p))
        else:
            bad = bad | (F.size(v) != self.p)
        if df.filter(F.coalesce(bad, F.lit(True))).limit(1).count():
            raise ValueError(f"null, not finite or misplaced numbers in {self.columns}")

    def block(self, batch: pa.RecordBatch) -> Dense | CSR:
        std = 1.0 if self.std is None else self.std
        if self.sparse:
            lists, v = batch.column(self.indices), batch.column(self.values)
            at = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            feature = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            value = v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            return CSR(at, feature, value / (std if np.isscalar(std) else std[feature]), self.p)
        if self.vector:
            x = batch.column(self.vector).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(batch.num_rows, self.p)
        else:
            x = np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in self.names]) if batch.num_rows else np.zeros((0, self.p))
        return Dense((x - (0.0 if self.mean is None else self.mean)) / std)

    def parts(self, batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
        """A batch in parts of at most ``most`` rows, and of at most ``BLOCK`` numbers if they are dense."""
        rows = max(1, most if self.sparse else min(most, BLOCK // self.p))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)

    def rows_of_batch(self, df: DataFrame) -> AbstractContextManager:
        """While this holds, Spark sends the rows of arrays to Python in batches of about ``BLOCK`` numbers instead of as many rows as it does of narrow ones."""
        key, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession
        before = int(spark.conf.get(key))
        rows = max(1, BLOCK // self.p)

        @contextmanager
        def held():
            if self.sparse or 0 < before <= rows:
                yield
                return
            spark.conf.set(key, rows)
            try:
                yield
            finally:
                spark.conf.set(key, before)

        return held()

    def predictor(self, coef: np.ndarray, intercept: float) -> Column:
        """The linear predictor as a column expression."""
        if not (self.sparse or self.vector):
            return fn.dot(self.names, coef, float(intercept))
        weights = F.array(*[F.lit(float(c)) for c in coef])
        if self.sparse:
            terms = F.zip_with(self.indices, self.values, lambda i, v: v * F.element_at(weights, (i + 1).cast("int")))
        else:
            terms = F.zip_with(self.vector, weights, lambda v, c: v * c)
        return F.aggregate(terms, F.lit(float(intercept)), lambda a, b: a + b)

    def moments(self, df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
        """Rows, and of each feature the mean and the population deviation (1 where that is 0), in one pass."""
        p = self.p

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros((2, p))
            for batch in batches:
                n += batch.num_rows
                for part in self.parts(batch, batch.num_rows):
                    total += self.block(part).sums()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * p + 1)), pa.array(np.r_[total.ravel(), n])], ["k", "v"])

        with self.rows_of_batch(df):
            rows = df.select(*self.columns).mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow().sort_by("k")["v"].to_numpy()  # 2 p + 1 numbers
        n = max(rows[-1], 1.0)
        mean = rows[:p] / n
        std = np.sqrt(np.maximum(rows[p : 2 * p] / n - mean**2, 0.0))
        return int(rows[-1]), mean, np.where(std > 1e-12 * np.maximum(1.0, np.abs(mean)), std, 1.0)


def sparse_rows(long: DataFrame, row: str, feature: str, value: str, labels: DataFrame | None = None) -> DataFrame:
    """Long (row, feature, value) entries as one row each with arrays ``indices`` and ``values`` in the order of the features, never a column per feature. Entries
    of one row and feature add up, zeros go. ``labels`` (row, ...) adds its columns, and its rows without entries with empty arrays."""
    cells = long.groupBy(row, feature).agg(F.sum(F.col(value).cast("double")).alias("v_")).filter(F.col("v_") != 0)
    pairs = F.array_sort(F.collect_list(F.struct(F.col(feature).cast("int").alias("i"), F.col("v_").alias("v"))))
    rows = cells.groupBy(row).agg(pairs.alias("e_")).select(row, F.col("e_.i").alias("indices"), F.col("e_.v").alias("values"))
    if labels is None:
        return rows
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return labels.join(rows, row, "left").withColumn("indices", none(F.col("indices"), "array<int>")).withColumn("values", none(F.col("values"), "array<double>"))
