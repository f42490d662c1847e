"""Linear models of wide designs against those on one Gram matrix."""

import resource

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparsonde.operators.design import Design
from sparsonde.plans import wide
from sparsonde.plans.linear import StableElasticNet, StableLasso


def _data(spark, n, p, on, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, p)) + 0.3 * rng.standard_normal((n, 1)) + 0.5
    y = x[:, on] @ rng.uniform(1, 2, len(on)) + 0.5 * rng.standard_normal(n) + 3
    return spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(n)], "row_id long, v array<double>, y double").repartition(4).cache(), x


@pytest.mark.parametrize("more", [{}, {"standardize": False, "warm_start": False}, {"fit_intercept": False}])
def test_equals_the_one_matrix_path(spark, monkeypatch, more):
    df, _ = _data(spark, 160, 40, [3, 17, 30])
    names = [f"x{j}" for j in range(40)]
    columns = df.select("row_id", "y", *[F.col("v")[j].alias(c) for j, c in enumerate(names)]).cache()
    monkeypatch.setattr(wide, "TILE", 6)
    monkeypatch.setattr(wide, "TASK_MB", 0.002)
    settings = {"n_boots_sel": 3, "n_boots_est": 3, "n_lambdas": 6, "eps": 0.05, "random_state": 2, "tol": 1e-9, "stability_selection": [0.7, 1.0], "estimation_score": "BIC", "alphas": (0.8,)} | more
    near = StableElasticNet(**settings).fit(columns, names, "y", "row_id")
    far = StableElasticNet(**settings).fit(df, Design(vector="v", p=40), "y", "row_id")
    assert np.allclose(near.settings_, far.settings_) and np.array_equal(near.supports_, far.supports_)
    assert np.abs(near.coef_ - far.coef_).max() < 1e-6 and abs(near.intercept_ - far.intercept_) < 1e-6
    a, b = (m.transform(t).select("row_id", "prediction").orderBy("row_id").toPandas()["prediction"] for m, t in ((near, columns), (far, df)))
    assert np.abs(a - b).max() < 1e-5 and len(far.proposed_) <= (39 if far.intercept_ else 40)


def test_thousands_of_features_in_bounded_memory(spark):
    on = [5, 1200, 4999]
    df, _ = _data(spark, 120, 5000, on, 3)
    m = StableLasso(n_boots_sel=4, n_boots_est=4, n_lambdas=4, eps=0.3, random_state=1, estimation_score="BIC").fit(df, Design(vector="v", p=5000), "y", "row_id", None)
    assert set(on) <= set(np.flatnonzero(m.coef_)) and len(m.proposed_) < 1000
    assert m.table(spark).filter("selected").count() >= 4
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss < 4 * 2**20


def test_sparse_features_and_constant_labels(spark):
    rng = np.random.default_rng(5)
    x = np.where(rng.random((200, 30)) < 0.2, rng.random((200, 30)), 0.0)
    y = 2 + 3 * x[:, 4] - 2 * x[:, 9] + 0.05 * rng.standard_normal(200)
    rows = [(i, np.flatnonzero(r).tolist(), r[r != 0].tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "row_id long, i array<int>, v array<double>, y double").repartition(2).cache()
    design = Design(indices="i", values="v", p=30)
    m = StableLasso(n_boots_sel=3, n_boots_est=3, n_lambdas=6, eps=0.05, random_state=1, estimation_score="BIC").fit(df, design, "y", "row_id")
    assert np.abs(m.coef_[[4, 9]] - [3, -2]).max() < 0.2 and abs(m.intercept_ - 2) < 0.1 and m.score(df, "y") > 0.95
    flat = StableLasso().fit(df.withColumn("y", F.lit(2.0)), design, "y", "row_id")
    assert not flat.coef_.any() and flat.intercept_ == 2


def test_batches_and_blocks_of_wide_rows_are_bounded(spark, monkeypatch):
    df, x = _data(spark, 300, 40, [3, 17])
    design = Design(vector="v", p=40)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr("sparsonde.operators.design.BLOCK", 40 * 16)
    batch = df.coalesce(1).toArrow().combine_chunks().to_batches()[0]
    assert max(p.num_rows for p in design.parts(batch, 4096)) == 16 and sum(p.num_rows for p in design.parts(batch, 4096)) == 300
    with design.rows_of_batch(df):
        seen = [r[0] for r in df.coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()]
    assert max(seen) <= 16 and sum(seen) == 300 and spark.conf.get(key) == before
    n, mean, std = design.moments(df)
    assert n == 300 and np.allclose(mean, x.mean(axis=0)) and np.allclose(std, x.std(axis=0))
    assert not list(design.parts(batch.slice(0, 0), 0)) and not list(Design(indices="v", values="v", p=40).parts(batch.slice(0, 0), 0))
