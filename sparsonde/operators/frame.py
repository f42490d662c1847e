"""The design matrix: a DataFrame with named feature columns, a label and a row id."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)


#: Equal rows are merged where that leaves so many times fewer.
FEWER = 4


@dataclass
class Stats:
    """Counts, means and population deviations of the features and the label."""

    n: int
    mean: np.ndarray
    std: np.ndarray
    y_mean: float
    y_std: float
    y_min: float
    y_max: float


@dataclass
class FeatureFrame:
    df: DataFrame
    features: list[str]
    label: str | None
    id_col: str

    def stats(self) -> Stats:
        """One pass; a column that doesn't vary has deviation 1."""
        y = F.col(self.label).cast("double") if self.label else F.lit(0.0)
        row = self.df.agg(F.count("*"), *[f(F.col(c).cast("double")) for c in self.features for f in (F.avg, F.stddev_pop)], F.avg(y), F.stddev_pop(y), F.min(y), F.max(y)).first()
        p = len(self.features)
        values = [float(v) if v is not None else 0.0 for v in row]
        std = np.array(values[2 : 1 + 2 * p : 2])
        return Stats(int(row[0]), np.array(values[1 : 1 + 2 * p : 2]), np.where(std > 0, std, 1.0), *values[1 + 2 * p : 2 + 2 * p], values[2 + 2 * p] or 1.0, *values[3 + 2 * p :])


def check(df: DataFrame, features: Sequence[str], label: str | None) -> None:
    """Raises ValueError unless the columns exist, are single numbers and hold no null, NaN or infinity."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for name in [*features, *([label] if label else [])]:
        if name not in kinds:
            raise ValueError(f"no column {name!r}")
        if not isinstance(kinds[name], NUMERIC) and (name != label or not isinstance(kinds[name], T.StringType)):
            raise ValueError(f"column {name!r} must be one number per row, not {kinds[name].simpleString()}")
    row = df.agg(*[F.count_if(bad_value(df, c)).alias(c) for c in [*features, *([label] if label else [])]]).first().asDict()
    if wrong := sorted(k for k, v in row.items() if v):
        raise ValueError(f"null, NaN or infinite values in {wrong}")


def bad_value(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.DoubleType | T.FloatType):
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return c.isNull()


def check_non_negative(df: DataFrame, features: Sequence[str]) -> None:
    if (low := df.agg(F.min(F.least(*[F.col(c) for c in features], F.lit(float("inf"))))).first()[0]) is not None and low < 0:
        raise ValueError("negative values")


def standardised(df: DataFrame, columns: Sequence[str], with_mean: bool = True) -> DataFrame:
    """``df`` with each of ``columns`` less its mean, divided by its population deviation (1 where that is 0)."""
    stats = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    out = df.crossJoin(F.broadcast(stats))  # a single row
    for i, c in enumerate(columns):
        centred = F.col(c) - F.col(f"m_{i}") if with_mean else F.col(c)
        out = out.withColumn(c, centred / F.when(F.col(f"s_{i}") == 0, 1.0).otherwise(F.col(f"s_{i}")))
    return out.select(*df.columns)


def restored(coef: np.ndarray, intercept: float | np.ndarray, mean: np.ndarray, std: np.ndarray, scale: float = 1.0) -> tuple[np.ndarray, float | np.ndarray]:
    """Coefficients (outputs x features, or features) and intercept for the columns as they were: features had been less ``mean`` over ``std``, and the label over ``scale``."""
    coef = coef * scale / std
    return coef, intercept - coef @ mean


def encoded(df: DataFrame, label: str, name: str = "label_index") -> DataFrame:
    """``df`` with the label's place among the sorted distinct labels, from 0. The distinct labels are joined by broadcast, a row per class: neither are the rows ranked nor do those of a class meet in a task."""
    classes = df.select(label).distinct().withColumn(name, (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int")).withColumnRenamed(label, "label_")
    return df.join(F.broadcast(classes), df[label].eqNullSafe(F.col("label_")), "left").drop("label_")


def merged(df: DataFrame, names: Sequence[str], weight: str | None = None) -> DataFrame | None:
    """Equal rows of ``names`` as one each, persisted, with the sum of their weights in ``times__``; None unless there are ``FEWER`` times fewer of them. Weights
    are scaled so that a weighted sum over the number of rows left is the one over all rows. The estimate of the distinct rows only decides whether to merge."""
    n, kinds = df.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*names))).first()
    if kinds * FEWER > n:
        return None
    kinds = df.groupBy(*names).agg((F.sum(weight) if weight else F.count("*")).cast("double").alias("times__")).persist()
    out = kinds.withColumn("times__", F.col("times__") * (kinds.count() / n)).persist()
    out.count()
    kinds.unpersist()
    return out


def one_hot(label: Column, classes: Sequence) -> list[Column]:
    return [F.when(label == k, 1).otherwise(0).alias(f"is_{k}") for k in classes]


def output_dim(classes: int, multi_class: str = "auto") -> int:
    """Outputs of a logistic model: one per class from three classes on or if ``multi_class`` is 'multinomial' (then 2 of two), else one."""
    if multi_class not in ("auto", "multinomial"):
        raise ValueError(f"multi_class must be 'auto' or 'multinomial', not {multi_class!r}")
    return classes if classes > 2 or multi_class == "multinomial" else 1


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): n / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("rows_"))
    every = Window.partitionBy()
    return counts.select(label, (F.sum("rows_").over(every) / (F.count("*").over(every) * F.col("rows_"))).alias("weight"))
