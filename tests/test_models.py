"""Whole models on synthetic data, their errors, and the queries against their SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sparsonde.operators import frame, resample, stability
from sparsonde.plans import catalogue
from sparsonde.plans.decomposition import ColumnSubset, NMFModel, StableColumns, StableNMF
from sparsonde.plans.glm import MaskedLogistic, PoissonGLM, StableL1Logistic, StablePoisson
from sparsonde.plans.linear import LinearModel, PathLasso, StableElasticNet, StableLasso
from sparsonde.sources import datasets, tables

DIR = "/root/testdata/sf0.001"


def names(p):
    return [f"x{j}" for j in range(p)]


@pytest.fixture(scope="session")
def linear(spark):
    df, beta, _ = datasets.linear_regression(spark, 400, 8, 3, snr=20, random_state=2)
    return df.repartition(4).cache(), beta


def test_lasso_recovers_its_support(linear):
    df, beta = linear
    model = StableLasso(n_boots_sel=8, n_boots_est=8, n_lambdas=20, random_state=1).fit(df, names(8), "y", "row_id")
    assert set(np.flatnonzero(model.coef_)) >= set(np.flatnonzero(beta)) and np.abs(model.coef_ - beta).max() < 0.5
    assert model.score(df, "y") > 0.9
    again = StableLasso(n_boots_sel=8, n_boots_est=8, n_lambdas=20, random_state=1).fit(df.repartition(7), names(8), "y", "row_id")
    other = StableLasso(n_boots_sel=8, n_boots_est=8, n_lambdas=20, random_state=2).fit(df, names(8), "y", "row_id")
    assert np.allclose(model.coef_, again.coef_, atol=1e-9) and (model.coef_ != other.coef_).any()


def test_toy_matrix_is_recovered_exactly(spark):
    x = np.array([[-1, 2], [4, 1], [1, 3], [4, 3], [8, 11]], float)
    x -= x.mean(axis=0)
    rows = [(i, *map(float, r), float(r @ [1, 4])) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, x0 double, x1 double, y double")
    model = StableLasso(selection_frac=0.75, estimation_frac=0.75, fit_intercept=False, random_state=1, n_boots_sel=6, n_boots_est=6).fit(df, names(2), "y", "row_id")
    assert np.allclose(model.coef_, [1, 4])
    tiled = df.unionAll(df.withColumn("row_id", F.col("row_id") + 5)).unionAll(df.withColumn("row_id", F.col("row_id") + 10))
    assert np.allclose(StableElasticNet(random_state=1, n_boots_sel=6, n_boots_est=6).fit(tiled, names(2), "y", "row_id").coef_, [1, 4])


@pytest.mark.parametrize("score", ["AIC", "AICc", "BIC", "r2"])
def test_scores_and_targets(linear, score):
    df, beta = linear
    for target in (None, "train", "test"):
        m = StableElasticNet(4, 4, n_lambdas=8, alphas=(0.5, 1.0), estimation_score=score, estimation_target=target, random_state=1).fit(df, names(8), "y", "row_id")
        assert m.coef_[np.flatnonzero(beta)].all()


def test_constant_labels_and_errors(spark, linear):
    df, _ = linear
    flat = StableLasso().fit(df.withColumn("y", F.lit(3.0)), names(8), "y", "row_id")
    assert not flat.coef_.any() and flat.intercept_ == 3
    for bad in ({"estimation_score": "mse"}, {"estimation_target": "all"}, {"stability_selection": 2.0}, {"solver": "x"}, {"solver": "path", "fit_intercept": False}):
        with pytest.raises(ValueError):
            StableLasso(**bad)
    with pytest.raises(ValueError):
        frame.check(df.withColumn("x0", F.lit(float("nan"))), names(2), "y")
    with pytest.raises(ValueError):
        frame.check(df.withColumn("y", F.array("x0")), names(2), "y")
    with pytest.raises(ValueError):
        StableLasso().set_params(nothing=1)
    assert StableLasso().set_params(eps=0.1).get_params()["eps"] == 0.1


def test_saved_models(spark, linear, tmp_path):
    model = LinearModel(names(3), [1.0, 0.0, -2.0], 0.5)
    model.save(spark, str(tmp_path / "m"))
    again = LinearModel.load(spark, str(tmp_path / "m"))
    assert again.features == model.features and list(again.coef_) == [1, 0, -2] and again.intercept_ == 0.5
    plan = model.transform(linear[0].select("x0", "x1", "x2"))._jdf.queryExecution().optimizedPlan().toString()
    assert "prediction" in plan and model.sparsify().numNonzeros() == 2


def test_path_lasso(linear):
    df, beta = linear
    m = PathLasso([0.0, 0.5, 1e6], tol=1e-10).fit(df, names(8), "y")
    assert not m.coef_[2].any() and np.abs(m.coef_[0] - beta).max() < 0.2 and m.transform(df).select(F.size("predictions")).first()[0] == 3
    for bad in (PathLasso(), PathLasso([1.0], fit_intercept=False)):
        with pytest.raises(ValueError):
            bad.fit(df, names(8), "y")
    with pytest.raises(ValueError):
        PathLasso([1.0]).transform(df)


def test_logistic(spark):
    df, w, _ = datasets.classification(spark, 300, 8, 3, random_state=6, w_scale=4.0)
    df = df.withColumn("y", F.when(F.col("y") == 1, "yes").otherwise("no")).cache()
    m = StableL1Logistic(6, 6, n_C=8, random_state=1).fit(df, names(8), "y", "row_id")
    on = np.flatnonzero(w[0])
    assert m.classes_ == ["no", "yes"] and (np.sign(m.coef_[0][on]) == np.sign(w[0][on])).mean() >= 0.6 and m.score(df, "y") > 0.8
    spread = StableL1Logistic(4, 4, n_C=4, eps=0.05, estimation_score="log", random_state=1, block_mb=0).fit(df, names(8), "y", "row_id")
    assert spread.score(df, "y") > 0.8
    p = m.transform(df).select(F.sum(F.col("probability")[0] + F.col("probability")[1])).first()[0]
    assert p == pytest.approx(300)


@pytest.mark.parametrize("shared", [True, False])
def test_multinomial(spark, shared):
    df, w, _ = datasets.classification(spark, 300, 5, 3, 3, shared_support=shared, random_state=10, w_scale=4.0)
    m = StableL1Logistic(4, 4, n_C=5, shared_support=shared, random_state=1).fit(df.cache(), names(5), "y", "row_id")
    assert m.coef_.shape == (3, 5) and m.score(df, "y") > 0.7
    with pytest.raises(ValueError):
        StableL1Logistic(multi_class="ovr")
    with pytest.raises(ValueError):
        StableL1Logistic().fit(df.withColumn("y", F.lit(1)), names(5), "y", "row_id")


def test_masked_and_weighted(spark):
    df, _, _ = datasets.classification(spark, 300, 4, 4, 3, random_state=3, w_scale=3.0)
    df = df.withColumn("w", F.lit(2.0)).cache()
    mask = np.array([[1, 0, 1, 0], [0, 1, 1, 0], [1, 1, 0, 0]], bool)
    m = MaskedLogistic(C=np.inf, class_weight="balanced", standardize=True).fit(df, names(4), "y", "w", mask)
    assert not m.coef_[~mask].any() and m.coef_[mask].all()
    assert not MaskedLogistic().fit(df, names(4), "y", coef_mask=np.zeros((3, 4), bool)).coef_.any()
    with pytest.raises(ValueError):
        MaskedLogistic(penalty="elastic")


@pytest.mark.parametrize("penalty", ["l1", "l2"])
def test_single_models_beyond_the_block_are_the_same(spark, penalty):
    df, _, _ = datasets.classification(spark, 300, 4, 4, 3, random_state=3, w_scale=3.0)
    df = df.withColumn("w", 1 + F.col("row_id") % 3).repartition(3).cache()
    mask = np.array([[1, 0, 1, 0], [0, 1, 1, 0], [1, 1, 0, 0]], bool)
    two = df.withColumn("y", (F.col("y") == 1).cast("int"))
    for rows, on in ((df, mask), (two, mask[:1]), (two, None), (two, np.zeros((1, 4), bool))):
        fit = lambda mb, rows=rows, on=on: MaskedLogistic(penalty, 1e-6, 20.0, class_weight="balanced", standardize=True, block_mb=mb).fit(rows, names(4), "y", "w", on)
        near, far = fit(256), fit(0)
        assert np.abs(near.coef_ - far.coef_).max() < 1e-4
        p, q = (m.transform(rows).select("row_id", "probability").orderBy("row_id").toPandas()["probability"] for m in (near, far))
        assert np.abs(np.array(p.tolist()) - np.array(q.tolist())).max() < 1e-3
    counts, _, _ = datasets.poisson_regression(spark, 400, 3, beta=[0.0, 1.0, 1.5], random_state=5, X_scale=0.5)
    counts = counts.withColumn("w", 1 + F.col("row_id") % 3).cache()
    fit = lambda mb: PoissonGLM(0.1, 1.0 if penalty == "l1" else 0.0, standardize=True, tol=1e-7, block_mb=mb).fit(counts, names(3), "y", "w")
    near, far = fit(256), fit(0)
    assert np.abs(near.coef_ - far.coef_).max() < 1e-4 and abs(near.intercept_ - far.intercept_) < 1e-4


def test_equal_rows_are_fitted_as_one(spark, monkeypatch):
    from sparsonde.plans import glm

    rng = np.random.default_rng(7)
    rows = [(float(g), int(y), float(w)) for g, y, w in zip(rng.integers(0, 3, 600), rng.integers(0, 3, 600), rng.integers(1, 4, 600), strict=True)]
    df = spark.createDataFrame(rows, "g double, y int, w double").repartition(3).cache()
    two = df.withColumn("y", (F.col("y") > 0).cast("int"))
    fits = [lambda mb, on=on, c=c, w=w: MaskedLogistic("l2", 1e-8, c, class_weight="balanced", standardize=True, block_mb=mb).fit(on, ["g"], "y", w) for on, c, w in ((two, np.inf, None), (two, 5.0, "w"), (df, 5.0, "w"))]
    fits.append(lambda mb: PoissonGLM(0.05, 0.5, standardize=True, tol=1e-8, block_mb=mb).fit(df, ["g"], "y", "w"))
    held, block, passes = [], glm._block, []
    monkeypatch.setattr(glm, "_block", lambda d, *a: held.append(d.count()) or block(d, *a))
    over = glm._over_rows
    monkeypatch.setattr(glm, "_over_rows", lambda d, *a: passes.append(d.count()) or over(d, *a))
    got = [fit(mb) for mb in (256, 0) for fit in fits]
    assert max(held) <= 9 and max(passes) <= 9
    monkeypatch.setattr(frame, "FEWER", np.inf)
    for m, want in zip(got, [fit(256) for fit in fits] * 2, strict=True):
        assert np.abs(np.ravel(m.coef_) - np.ravel(want.coef_)).max() < 1e-4 and np.abs(np.ravel(m.intercept_) - np.ravel(want.intercept_)).max() < 1e-4


def test_poisson(spark):
    df, beta, _ = datasets.poisson_regression(spark, 1500, 3, beta=[0.0, 1.0, 1.5], random_state=5, X_scale=0.5)
    df = df.cache()
    for more in ({}, {"solver": "cd"}, {"block_mb": 0, "n_boots_sel": 3, "n_boots_est": 3, "n_lambdas": 4}):
        m = StablePoisson(**({"n_boots_sel": 5, "n_boots_est": 5, "n_lambdas": 8, "random_state": 1} | more)).fit(df, names(3), "y", "row_id")
        assert np.abs(m.coef_ - beta).max() < 0.25
    one = PoissonGLM(alpha=0.0).fit(df, names(3), "y")
    assert np.abs(one.coef_ - beta).max() < 0.25
    assert one.transform(df).filter(F.col("prediction") != F.floor("mean")).count() == 0
    assert np.isneginf(StablePoisson().fit(df.withColumn("y", F.lit(0)), names(3), "y", "row_id").intercept_)
    for bad in ({"estimation_score": "acc"}, {"solver": "newton"}):
        with pytest.raises(ValueError):
            StablePoisson(**bad)


def test_a_block_is_bounded_by_what_tasks_hold(spark):
    from sparsonde.plans import glm

    df = spark.range(1000).selectExpr("id", "double(id) AS x", "double(id % 3) AS y")
    mb = 1000 * 2 * 8 / 2**20
    assert glm._block(df, ["x", "y"], "id", 1000, 2 * mb, None) is None
    ids, block, _ = glm._block(df, ["x", "y"], "id", 1000, 10 * mb, None)
    assert ids.tolist() == list(range(1000)) and block.shape == (1000, 2)


def test_columns(spark, linear):
    df, _ = linear
    some = ColumnSubset(3, random_state=1).fit(df, names(8), c=3)
    assert set(some.columns_) <= set(names(8)) and some.transform(df).columns == some.columns_
    all_ = StableColumns(4, 3, 0.8, 0.25, random_state=1).fit(df, names(8), id_col="row_id")
    few = StableColumns(4, 3, 0.8, 1.0, random_state=1).fit(df, names(8), ks=3, cs=3, id_col="row_id")
    assert set(few.columns_) <= set(all_.columns_)
    assert StableColumns(2, 3, 1).fit(df, names(8)).columns_
    with pytest.raises(ValueError):
        ColumnSubset(9).fit(df, names(8))


@pytest.mark.parametrize("loss", ["kullback-leibler", "frobenius"])
def test_factorisation_beyond_the_block(spark, loss):
    rng = np.random.default_rng(4)
    parts = np.array([[5, 4, 0, 0, 0, 1], [0, 0, 3, 6, 0, 1], [0, 1, 0, 0, 4, 5]], float)
    x = rng.gamma(0.5, 1.0, (300, 3)) @ parts + rng.random((300, 6)) * 0.01
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], ["row_id", *names(6)]).repartition(3).cache()
    fit = lambda mb, rows=df: StableNMF(3, [3], nmf_beta_loss=loss, db_eps=0.4, random_state=1, nmf_max_iter=120, block_mb=mb).fit(rows, names(6), "row_id")
    far, again = fit(0), fit(0, df.repartition(5))
    assert np.allclose(far.components_, again.components_, atol=1e-6)
    unit = parts / np.linalg.norm(parts, axis=1, keepdims=True)
    for m in (fit(256), far):
        assert len(m.components_) == 3 and (m.components_ @ unit.T).max(axis=0).min() > 0.98
        assert m.transform(df, error="err").select(F.sum("err")).first()[0] < 0.01 * (x**2).sum()
    with pytest.raises(ValueError):
        StableNMF(2, [2], nmf=lambda *a: a, block_mb=0).fit(df, names(6), "row_id")


def test_factorisation(spark):
    images = datasets.parts_images(spark, 8, 2, 4)
    pixels = [c for c in images.columns if c != "row_id"]
    m = StableNMF(4, 4, random_state=1, nmf_max_iter=150, db_eps=0.6).fit(images, pixels, "row_id")
    out = m.transform(images, error="err")
    assert m.components_.shape[1] == len(pixels) and out.filter(F.exists("weights", lambda w: w < 0)).count() == 0
    assert m.inverse_transform(out).select(F.size("reconstructed")).first()[0] == len(pixels)
    flat = StableNMF(2, [2, 3], use_dissimilarity=False, random_state=1, nmf_max_iter=20).fit(images, pixels, "row_id")
    assert len(flat.bases_samples_) == 10
    with pytest.raises(ValueError):
        StableNMF(1)
    with pytest.raises(ValueError):
        StableNMF(2, 2).fit(images.withColumn("p0", F.lit(-1.0)), pixels)
    with pytest.raises(ValueError):
        NMFModel(["no"], np.eye(1)).transform(images)


def test_splits_are_exact_and_portable(spark):
    df = spark.range(997).withColumn("g", F.col("id") % 3)
    rows = resample.split(df, "id", 3, 0.8, 5).collect()
    h = {b: resample.hash_array(np.arange(997), b, 5) for b in range(3)}
    for b in range(3):
        test = {r.id for r in rows if r.boot == b and not r.is_train}
        assert test == set(np.lexsort((np.arange(997), h[b]))[:200].tolist())
    by = resample.split(df, "id", 2, 0.9, 5, "g").groupBy("boot", "g").agg(F.count_if(~F.col("is_train")).alias("n")).collect()
    assert {(r.g, r.n) for r in by} == {(0, 34), (1, 34), (2, 34)}
    assert sorted(x.row_id for x in resample.with_row_id(spark.createDataFrame([(3,), (1,)], "x long"), ["x"]).collect()) == [0, 1]


def test_only_the_rows_of_the_cuts_bins_move(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = resample.cutoffs(spark.range(997).withColumn("g", F.col("id") % 3), "id", 3, 0.8, 5, "g")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_derived_rows_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = datasets.linear_regression(spark, 200, 3, 2, random_state=2)[0]
    fitted = StableLasso(n_boots_sel=3, n_boots_est=3, n_lambdas=4, random_state=1).fit(df.mapInArrow(count, df.schema), names(3), "y", "row_id")
    assert seen.value == 200 and fitted.coef_.any()
    with pytest.raises(ValueError, match="no column"):
        StableLasso().fit(df, names(4), "y", "row_id")


def test_intersections(spark):
    cube = [[[2, 1, 0, 0, 1], [0, 2, 0, 3, 0], [1, 0, 0, 5, 1]], [[1, 1, 0, 0, 0], [0, 1, 0, 2, 0], [0, 0, 1, 5, 1]], [[3, 1, 0, 1, 1], [0, 0, 0, 2, 0], [1, 0, 0, 5, 0]]]
    rows = [(b, r, j, float(v)) for b, x in enumerate(cube) for r, y in enumerate(x) for j, v in enumerate(y)]
    coefs = spark.createDataFrame(rows, "boot int, reg_idx int, feature int, coef double")
    for limits in ([3], [2], [2, 3]):
        want = sorted({tuple(sum(cube[b][r][j] != 0 for b in range(3)) >= t for j in range(5)) for t in limits for r in range(3)})
        got = stability.intersections(coefs, limits).orderBy("support_id").collect()
        assert [tuple(x.support) for x in got] == want and [x.support_id for x in got] == list(range(len(want)))


def test_sources(spark, tmp_path):
    tables.save_tables({"a": spark.range(5).selectExpr("id", "id * 2.0 AS x", "id AS y")}, str(tmp_path))
    assert tables.load_xy(spark, str(tmp_path / "a"), ["x"], "y").columns == ["x", "y"]
    long = spark.createDataFrame([(1, 0, 2.0, "a"), (1, 2, 3.0, "a"), (2, 1, 1.0, "b")], "row long, feature long, value double, y string")
    got = {r.row: (r.x0, r.x1, r.x2, r.y) for r in tables.sparse_to_wide(long, "row", "feature", "value", [0, 1, 2], "y").collect()}
    assert got == {1: (2.0, 0.0, 3.0, "a"), 2: (0.0, 1.0, 0.0, "b")}


def test_row_ids_follow_content(spark):
    rows = [(float(i % 7), float(i * i % 31)) for i in range(300)]
    ids = lambda parts: sorted(map(tuple, resample.with_row_id(spark.createDataFrame(rows, "x double, y double").repartition(parts), ["x", "y"]).collect()))
    assert ids(1) == ids(5) and sorted(x[2] for x in ids(3)) == list(range(300))


@pytest.mark.parametrize("stratify", [None, "s"])
def test_distributed_logistic_equals_the_block(spark, stratify):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 4))
    y = (rng.random(600) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 2 * x[:, 2])))).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(v), f"s{i % 3}") for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, d double, y int, s string")
    fit = lambda mb: StableL1Logistic(n_boots_sel=4, n_boots_est=4, Cs=[20.0, 100.0], tol=1e-7, random_state=2, block_mb=mb).fit(df, list("abcd"), "y", "id", stratify)
    block, spread = fit(256), fit(0)
    assert np.array_equal(block.supports_, spread.supports_) and spread.settings_ == pytest.approx(block.settings_)
    a, b = (m.scores_.orderBy("boot", "support_id").toPandas()["score"] for m in (block, spread))
    assert np.abs(a - b).max() < 0.02
    assert np.allclose(block.coef_, spread.coef_, atol=1e-3) and np.allclose(block.intercept_, spread.intercept_, atol=1e-3)


def test_streams(spark, tmp_path):
    from sparsonde.streaming import scoring

    spark.range(100).selectExpr("id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, int(id)) AS ts", "double(id) AS x", "double(id) * 2 AS y").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp, x double, y double").parquet(str(tmp_path / "in"))
    for name, df, mode in (("scored_t", scoring.scored(stream, LinearModel(["x"], [2.0], 1.0)), "append"), ("moments_t", scoring.windowed_moments(stream, "ts", "x", "y"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("scored_t").filter("prediction = y + 1").count() == 100
    assert spark.table("moments_t").agg(F.sum("n"), F.sum("sxy")).first()[:] == (100, sum(2.0 * i * i for i in range(100)))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("supplier", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = catalogue.queries()[name](spark, DIR).toPandas()
    want = con.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    order = [c for c in sorted(got.columns) if got[c].dtype.kind != "f"] + [c for c in sorted(got.columns) if got[c].dtype.kind == "f"]
    got, want = (x[order].sort_values(order).reset_index(drop=True) for x in (got, want))
    for c in order:
        if got[c].dtype.kind == "f":
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-6, atol=1e-5)
        else:
            assert (got[c] == want[c]).all()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
