"""Synthetic data, made by the executors: the same seed gives the same rows for the same number of partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsonde.functions import columns as fn


def _features(spark: SparkSession, n: int, p: int, loc: float, scale: float, seed: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("row_id"), *[(F.randn(seed * 1000 + j) * scale + loc).alias(f"x{j}") for j in range(p)])


def _coefficients(rng: np.random.Generator, p: int, informative: int, draw) -> np.ndarray:
    beta = np.zeros(p)
    beta[rng.permutation(p)[:informative]] = draw(informative)
    return beta


def linear_regression(spark: SparkSession, n_samples=100, n_features=5, n_informative=2, X_loc=3.0, X_scale=1.0, snr=5.0, beta=None, beta_low=1.0, beta_high=3.0, include_intercept=False, random_state=0) -> tuple[DataFrame, np.ndarray, float]:
    """(row_id, x0 .., y), coefficients and intercept; the noise's variance is the signal's over ``snr``."""
    rng = np.random.default_rng(random_state)
    beta = _coefficients(rng, n_features, n_informative, lambda k: rng.uniform(beta_low, beta_high, k)) if beta is None else np.asarray(beta, float)
    intercept = float(rng.uniform(beta_low, beta_high)) if include_intercept else 0.0
    df = _features(spark, n_samples, n_features, X_loc, X_scale, random_state)
    eta = fn.dot([f"x{j}" for j in range(n_features)], beta, intercept)
    noise = np.sqrt((df.agg(F.var_pop(eta)).first()[0] or 0.0) / snr) if snr else 0.0
    return df.withColumn("y", eta + F.randn(random_state * 1000 + 999) * float(noise)), beta, intercept


def classification(spark: SparkSession, n_samples=100, n_features=20, n_informative=2, n_classes=2, shared_support=False, random_state=0, w_scale=1.0, include_intercept=False) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(row_id, x0 .., y) with each row's features scaled to mean 0 and deviation 1; labels drawn from the model."""
    rng = np.random.default_rng(random_state)
    outputs = 1 if n_classes == 2 else n_classes
    if shared_support:
        on = _coefficients(rng, n_features, n_informative, np.ones) > 0
        w = np.where(on, rng.standard_normal((outputs, n_features)) * w_scale, 0.0)
    else:
        w = np.array([_coefficients(rng, n_features, n_informative, lambda k: rng.standard_normal(k) * w_scale) for _ in range(outputs)])
    b = rng.standard_normal(outputs) * w_scale if include_intercept else np.zeros(outputs)
    names = [f"x{j}" for j in range(n_features)]
    df = _features(spark, n_samples, n_features, 0.0, 1.0, random_state).withColumn("a", F.array(*names))
    mean = F.aggregate("a", F.lit(0.0), lambda s, v: s + v) / n_features
    df = df.withColumn("m", mean).withColumn("s", F.sqrt(F.aggregate("a", F.lit(0.0), lambda s, v: s + (v - F.col("m")) * (v - F.col("m"))) / n_features))
    df = df.select("row_id", *[((F.col(c) - F.col("m")) / F.col("s")).alias(c) for c in names])
    u = F.rand(random_state * 1000 + 998)
    etas = [fn.dot(names, c, v) for c, v in zip(w, b, strict=True)]
    if outputs == 1:
        return df.withColumn("y", (u < fn.sigmoid(etas[0])).cast("int")), w, b
    df = df.withColumn("p", fn.softmax(F.array(*etas))).withColumn("u", u)
    label: Column = F.lit(0)
    below: Column = F.lit(0.0)
    for k in range(n_classes - 1):
        below = below + F.col("p")[k]
        label = label + (F.col("u") >= below).cast("int")
    return df.withColumn("y", label).drop("p", "u"), w, b


def poisson_regression(spark: SparkSession, n_samples=100, n_features=5, n_informative=2, X_loc=0.0, X_scale=1 / 8, beta=None, beta_shape=1.0, beta_scale=3.0, include_intercept=False, random_state=0) -> tuple[DataFrame, np.ndarray, float]:
    """(row_id, x0 .., y): counts drawn per task from a generator seeded by the task's first row."""
    rng = np.random.default_rng(random_state)
    beta = _coefficients(rng, n_features, n_informative, lambda k: rng.gamma(beta_shape, beta_scale, k)) if beta is None else np.asarray(beta, float)
    intercept = float(rng.gamma(beta_shape, beta_scale)) if include_intercept else 0.0
    df = _features(spark, n_samples, n_features, X_loc, X_scale, random_state).withColumn("mu", F.exp(fn.dot([f"x{j}" for j in range(n_features)], beta, intercept)))

    def draw(batches):
        for batch in batches:
            first = batch.column("row_id")[0].as_py() if batch.num_rows else 0
            y = np.random.default_rng([random_state, first]).poisson(np.minimum(batch.column("mu").to_numpy(), 1e15))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c != "mu"], pa.array(y.astype(np.int64))], [*[c for c in batch.schema.names if c != "mu"], "y"])

    return df.mapInArrow(draw, df.drop("mu").schema.add("y", "long")), beta, intercept


def parts_images(spark: SparkSession, side: int = 16, parts: int = 4, positions: int = 4) -> DataFrame:
    """(row_id, p0 ..): every image of ``parts`` limbs, each in one of ``positions`` places; pixels are 0 or 1. A stand-in for images made of parts."""
    n = side * side
    images = spark.range(positions**parts).select(F.col("id").alias("row_id"))
    width = n // (parts * positions)
    for j in range(n):
        part, place = divmod(j // width, positions)
        lit = F.lit(False) if part >= parts else (F.floor(F.col("row_id") / positions**part) % positions) == place
        images = images.withColumn(f"p{j}", lit.cast("double")) if n <= 64 else images
    if n > 64:
        columns = [((F.floor(F.col("row_id") / positions ** min(j // width // positions, parts - 1)) % positions) == (j // width) % positions).cast("double").alias(f"p{j}") for j in range(n)]
        images = images.select("row_id", *columns)
    return images
