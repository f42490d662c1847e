"""Models of any family on distributed rows against the block, and designs of arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsonde.operators import families, frame, kernels
from sparsonde.operators.design import CSR, Dense, Design, sparse_rows
from sparsonde.plans import lockstep
from sparsonde.plans.glm import StableGLM, StableL1Logistic
from sparsonde.sources import datasets


def names(p):
    return [f"x{j}" for j in range(p)]


class NegativeBinomial(families.Family):
    """Counts of variance mu + mu^2 / size."""

    def __init__(self, size):
        self.size = size

    def terms(self, eta, y):
        e = np.clip(eta[:, 0], -30, 30)
        mu, s = np.exp(e), self.size
        return (y + s) * np.log(mu + s) - y * e, ((y + s) * mu / (mu + s) - y)[:, None]

    def alone(self, means):
        return np.log(np.maximum(means, 1e-10))

    def mean(self, eta):
        return F.exp(eta[0])


@pytest.mark.parametrize(("shared", "stratify", "intercept"), [(True, None, True), (False, "s", True), (False, None, False)])
def test_multinomial_beyond_the_block_is_the_same(spark, shared, stratify, intercept):
    df, _, _ = datasets.classification(spark, 500, 5, 3, 3, shared_support=shared, random_state=10, w_scale=1.2)
    df = df.withColumn("s", F.concat(F.lit("s"), F.col("row_id") % 3)).repartition(3).cache()
    fit = lambda mb: StableL1Logistic(2, 2, Cs=[15.0], tol=3e-6, max_iter=300, shared_support=shared, random_state=2, fit_intercept=intercept, block_mb=mb, estimation_score="BIC").fit(df, names(5), "y", "row_id", stratify)
    block, spread = fit(256), fit(0)
    assert np.array_equal(block.supports_, spread.supports_) and spread.scores_.count() == block.scores_.count() and spread.settings_ == block.settings_
    assert np.abs(block.coef_ - spread.coef_).max() < 1e-4 and np.abs(block.intercept_ - spread.intercept_).max() < 1e-4


def test_a_family_of_ones_own(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 4))
    mu = np.exp(0.5 + 0.8 * x[:, 0] - 0.6 * x[:, 2])
    y = rng.poisson(mu * rng.gamma(2.0, 0.5, 700))
    df = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], ["id", *names(4), "y"]).repartition(3).cache()
    fit = lambda mb: StableGLM(NegativeBinomial(2.0), 2, 2, settings=[(0.3, 1.0), (0.05, 0.8)], tol=3e-6, max_iter=300, random_state=2, block_mb=mb, estimation_score="BIC").fit(df, names(4), "y", "id")
    block, spread = fit(256), fit(0)
    assert np.array_equal(block.supports_, spread.supports_)
    assert np.abs(block.coef_ - spread.coef_).max() < 1e-4 and np.abs(block.intercept_ - spread.intercept_).max() < 1e-4
    assert np.abs(spread.coef_[0] - [0.8, 0, -0.6, 0]).max() < 0.2
    assert abs(spread.transform(df).agg(F.avg("mean")).first()[0] / y.mean() - 1) < 0.1


@pytest.mark.parametrize("family", [families.Logistic(), families.Multinomial(3), families.Poisson(), NegativeBinomial(1.5)])
def test_derivatives(family):
    rng = np.random.default_rng(1)
    eta, y = rng.standard_normal((20, family.outputs)), rng.integers(0, max(family.outputs, 2), 20)
    _, r = family.terms(eta, y)
    for j in range(family.outputs):
        step = 1e-6 * np.eye(family.outputs)[j]
        assert np.allclose((family.terms(eta + step, y)[0] - family.terms(eta - step, y)[0]) / 2e-6, r[:, j], atol=1e-5)


def test_many_right_hand_sides_at_once():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((50, 6))
    gram, cross, lam = x.T @ x / 50, rng.standard_normal((9, 6)), np.linspace(0.01, 0.8, 9)
    got = kernels.descents(gram, cross, lam[:, None], np.full((9, 1), 0.7), np.zeros((9, 6)), 2000, 1e-12)
    for i in range(9):
        assert np.allclose(got[i], kernels.descent(gram, cross[i], lam[i], 0.7, None, 2000, 1e-12), atol=1e-9)


def test_sparse_products():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 11)) * (rng.random((40, 11)) < 0.2)
    x[7] = 0
    row, col = np.nonzero(x)
    twice = np.r_[x[row, col] / 2, x[row, col] / 2]
    order = np.argsort(np.r_[row, row], kind="stable")
    csr = CSR(np.r_[0, np.cumsum(2 * np.bincount(row, minlength=40))], np.r_[col, col][order], twice[order], 11)
    dense, w, r = Dense(x), rng.standard_normal((11, 70)), rng.standard_normal((40, 70))
    for a, b in ((csr.times(w), dense.times(w)), (csr.transposed(r), dense.transposed(r)), (csr.dense(), x), (csr.columns(np.array([4, 1])), x[:, [4, 1]]), (csr.row_bound(), dense.row_bound()), (csr.slice(5, 9).dense(), x[5:9])):
        assert np.allclose(a, b)
    assert np.allclose(csr.sums(), dense.sums())
    assert np.linalg.eigvalsh(np.diag(dense.row_bound()) - x.T @ x).min() > -1e-9


@pytest.fixture(scope="module")
def sparse(spark):
    """100 rows of 100 sparse features, three classes named by strings, as long entries, and as columns."""
    rng = np.random.default_rng(17)
    x = np.where(rng.random((100, 100)) < 0.05, rng.random((100, 100)), 0.0)
    x[5] = 0
    x[:, 3] = rng.random(100)
    score = np.c_[x[:, 3] * 3, np.full(100, 1.5), rng.random(100) * 2] + rng.random((100, 3)) * 3
    y = np.array(["abc", "de", "fgh"])[score.argmax(axis=1)]
    long = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "row_id long, feature int, value double").repartition(3)
    labels = spark.createDataFrame([(i, str(v)) for i, v in enumerate(y)], "row_id long, y string")
    wide = spark.createDataFrame([(i, str(v), *map(float, r)) for i, (v, r) in enumerate(zip(y, x, strict=True))], ["row_id", "y", *names(100)])
    return sparse_rows(long, "row_id", "feature", "value", labels).cache(), wide.cache(), x


def test_sparse_input_stays_sparse_and_fits_the_same(spark, sparse):
    rows, wide, _ = sparse
    assert rows.columns == ["row_id", "y", "indices", "values"] and rows.count() == 100
    design = Design(indices="indices", values="values", p=100)
    settings = {"n_boots_sel": 3, "n_boots_est": 3, "Cs": [12.0, 18.0], "fit_intercept": False, "standardize": False, "random_state": 3, "tol": 1e-5, "max_iter": 200, "estimation_score": "BIC"}
    block = StableL1Logistic(**settings).fit(wide, names(100), "y", "row_id")
    far = StableL1Logistic(**settings).fit(rows, design, "y", "row_id")
    assert np.array_equal(block.supports_, far.supports_) and np.abs(block.coef_ - far.coef_).max() < 1e-3 and far.coef_.any()
    got = {r["row_id"]: r["prediction"] for r in far.transform(rows).collect()}
    want = {r["row_id"]: r["prediction"] for r in block.transform(wide).collect()}
    assert got == want and set(got.values()) <= {"abc", "de", "fgh"}


def test_sparse_input_cant_be_centred(sparse):
    rows, _, _ = sparse
    with pytest.raises(ValueError):
        StableL1Logistic(fit_intercept=True).fit(rows, Design(indices="indices", values="values", p=100), "y", "row_id")
    for bad in (Design(indices="indices", values="values", p=50), Design(vector="values", p=100)):
        with pytest.raises(ValueError):
            StableL1Logistic(fit_intercept=False).fit(rows, bad, "y", "row_id")
    with pytest.raises(ValueError):
        Design()


def test_wide_designs_take_the_diagonal(spark, monkeypatch):
    df, _, _ = datasets.classification(spark, 400, 4, 2, 3, random_state=5, w_scale=1.5)
    df = df.repartition(2).cache()
    fit = lambda mb: StableL1Logistic(2, 2, Cs=[10.0], tol=1e-5, random_state=2, block_mb=mb, estimation_score="BIC").fit(df, names(4), "y", "row_id")
    near = fit(256)
    monkeypatch.setattr(lockstep, "WIDE", 2)
    far = fit(0)
    assert np.array_equal(near.supports_, far.supports_) and np.abs(near.coef_ - far.coef_).max() < 5e-3


def test_an_array_column_equals_columns(spark):
    few, _, _ = datasets.classification(spark, 300, 5, 2, random_state=4, w_scale=1.2)
    few = few.withColumn("v", F.array(*names(5))).repartition(2).cache()
    settings = {"n_boots_sel": 2, "n_boots_est": 2, "max_iter": 300, "Cs": [20.0], "random_state": 3, "tol": 1e-5, "estimation_score": "BIC"}
    a, b = StableL1Logistic(**settings).fit(few, names(5), "y", "row_id"), StableL1Logistic(**settings).fit(few, Design(vector="v", p=5), "y", "row_id")
    assert np.array_equal(a.supports_, b.supports_) and np.abs(a.coef_ - b.coef_).max() < 5e-3 and np.abs(a.intercept_ - b.intercept_).max() < 5e-3
    n, mean, std = Design(vector="v", p=5).moments(few)
    x = np.array([r["v"] for r in few.select("v").collect()])
    assert n == 300 and np.allclose(mean, x.mean(axis=0)) and np.allclose(std, np.where(x.std(axis=0) > 0, x.std(axis=0), 1)) and math.isclose(mean[3], x[:, 3].mean())


def test_encoding_leaves_rows_where_they_are(spark):
    df = spark.range(1000).selectExpr("id", "concat('c', id % 3) AS y")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = frame.encoded(df, "y", "k")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {(r.y, r.k) for r in out.collect()} == {("c0", 0), ("c1", 1), ("c2", 2)} and out.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
