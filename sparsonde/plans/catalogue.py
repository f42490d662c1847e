"""The library's queries by name, and the SQL that gives the same rows.

Floating-point results are rounded (6 digits unless said otherwise) on both sides, as sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparsonde import functions as fn
from sparsonde.operators import frame as fr
from sparsonde.operators import density, grids, resample, stability
from sparsonde.operators.resample import hash_sql
from sparsonde.sources import tables

SEED = 11
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(c: Column, name: str, digits: int = 6) -> Column:
    return (F.round(c, digits) + F.lit(0.0)).alias(name)


# preprocessing


@query("""SELECT 'l_quantity' AS feature, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std FROM lineitem
UNION ALL SELECT 'l_extendedprice', round(avg(l_extendedprice), 6), round(stddev_pop(l_extendedprice), 6) FROM lineitem
UNION ALL SELECT 'l_discount', round(avg(l_discount), 6), round(stddev_pop(l_discount), 6) FROM lineitem
UNION ALL SELECT 'l_tax', round(avg(l_tax), 6), round(stddev_pop(l_tax), 6) FROM lineitem""")
def column_stats(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    one = t(spark, d, "lineitem").agg(*[f(c).alias(f"{k}_{c}") for c in names for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), r(F.col(f"m_{c}"), "mean"), r(F.col(f"s_{c}"), "std")) for c in names])
    return one.select(F.inline(rows))


@query("""SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / CASE WHEN stddev_pop(o_totalprice) OVER () = 0 THEN 1 ELSE stddev_pop(o_totalprice) OVER () END, 6) + 0.0 AS z FROM orders""")
def standardize_features(spark, d):
    return fr.standardised(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).select("o_orderkey", r(F.col("o_totalprice"), "z"))


@query("SELECT min(l_tax) = max(l_tax) AS constant_tax, min(l_quantity) >= 0 AS quantity_ok, count(*) FILTER (WHERE l_tax IS NULL OR isnan(l_tax) OR isinf(l_tax)) AS bad_tax FROM lineitem")
def response_checks(spark, d):
    df = t(spark, d, "lineitem")
    tax = fr.FeatureFrame(df, ["l_quantity"], "l_tax", "l_orderkey").stats()
    try:
        fr.check_non_negative(df, ["l_quantity"])
        ok = True
    except ValueError:
        ok = False
    bad = df.agg(F.count_if(fr.bad_value(df, "l_tax"))).first()[0]
    return spark.createDataFrame([(tax.y_min == tax.y_max, ok, bad)], "constant_tax boolean, quantity_ok boolean, bad_tax long")


@query("SELECT l_returnflag, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS label_index, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def label_encode(spark, d):
    return fr.encoded(t(spark, d, "lineitem").select("l_returnflag"), "l_returnflag").groupBy("l_returnflag", F.col("label_index").cast("long").alias("label_index")).agg(F.count("*").alias("n"))


@query("SELECT l_linestatus, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS is_a, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)::BIGINT AS is_n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS is_r FROM lineitem GROUP BY l_linestatus")
def one_hot(spark, d):
    hot = t(spark, d, "lineitem").select("l_linestatus", *fr.one_hot(F.col("l_returnflag"), ["A", "N", "R"]))
    return hot.groupBy("l_linestatus").agg(*[F.sum(f"is_{k}").alias(f"is_{k.lower()}") for k in "ANR"])


@query("SELECT l_returnflag, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM lineitem GROUP BY l_returnflag")
def class_weights(spark, d):
    return fr.class_weights(t(spark, d, "lineitem"), "l_returnflag").select("l_returnflag", r(F.col("weight"), "weight"))


@query("""WITH best AS (SELECT 2.5 AS c1, -1.25 AS c2, avg(l_extendedprice) AS ym, stddev_pop(l_extendedprice) AS ys, avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_tax) AS m2, stddev_pop(l_tax) AS s2 FROM lineitem)
SELECT round(c1 * ys / s1, 4) AS coef_quantity, round(c2 * ys / s2, 4) AS coef_tax, round(ym - m1 * c1 * ys / s1 - m2 * c2 * ys / s2, 4) AS intercept FROM best""")
def unstandardise_linear(spark, d):
    s = fr.FeatureFrame(t(spark, d, "lineitem"), ["l_quantity", "l_tax"], "l_extendedprice", "l_orderkey").stats()
    coef, intercept = fr.restored(np.array([2.5, -1.25]), s.y_mean, s.mean, s.std, s.y_std)
    row = spark.createDataFrame([(*map(float, coef), float(intercept))], "a double, b double, c double")
    return row.select(r(F.col("a"), "coef_quantity", 4), r(F.col("b"), "coef_tax", 4), r(F.col("c"), "intercept", 4))


@query("""WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd FROM lineitem)
SELECT round(0.4 / sd, 8) AS coef, round(1.5 - m * 0.4 / sd, 8) AS intercept FROM s""")
def unstandardise_glm(spark, d):
    s = fr.FeatureFrame(t(spark, d, "lineitem"), ["l_quantity"], "l_tax", "l_orderkey").stats()
    coef, intercept = fr.restored(np.array([0.4]), 1.5, s.mean, s.std)
    return spark.createDataFrame([(float(coef[0]), float(intercept))], "a double, b double").select(r(F.col("a"), "coef", 8), r(F.col("b"), "intercept", 8))


@query("SELECT f.feature, coalesce(e.coef, 0.0) AS coef FROM (VALUES ('l_quantity'), ('l_discount'), ('l_tax')) f(feature) LEFT JOIN (SELECT 'l_tax' AS feature, round(regr_slope(l_extendedprice, l_tax), 4) AS coef FROM lineitem) e ON e.feature = f.feature")
def scatter_estimates(spark, d):
    from sparsonde.operators import suffstats

    from .linear import StableLasso

    names = ["l_quantity", "l_discount", "l_tax"]
    frame = fr.FeatureFrame(t(spark, d, "lineitem"), names, "l_extendedprice", "l_orderkey")
    whole = suffstats.boot_grams(frame, frame.stats(), {"est": (1, 1.0, SEED)})
    row = StableLasso()._estimates(whole, np.array([[False, False, True]])).first()
    s = frame.stats()
    coef, _ = fr.restored(np.array(row["coefs"]), s.y_mean, s.mean, s.std, s.y_std)
    return spark.createDataFrame([(n, float(c)) for n, c in zip(names, coef, strict=True)], "feature string, coef double").select("feature", r(F.col("coef"), "coef", 4))


# resampling

_SPLIT = f"""SELECT o_orderkey AS id, boot, o_totalprice AS y, row_number() OVER (PARTITION BY boot ORDER BY {hash_sql('o_orderkey', 'boot', SEED)}, o_orderkey) > ceil(0.1 * count(*) OVER (PARTITION BY boot) - 1e-9) AS is_train
FROM orders, range(6) b(boot)"""


@query(f"SELECT boot, is_train, count(*) AS n, sum(id)::BIGINT AS ids FROM ({_SPLIT}) GROUP BY boot, is_train")
def resample_split(spark, d):
    rows = resample.split(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 6, 0.9, SEED)
    return rows.groupBy(F.col("boot").cast("long").alias("boot"), "is_train").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"))


@query(f"""SELECT boot, event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (SELECT event_id, event_type, boot, row_number() OVER (PARTITION BY boot, event_type ORDER BY {hash_sql('event_id', 'boot', SEED)}, event_id) > ceil((1 - 0.8) * count(*) OVER (PARTITION BY boot, event_type) - 1e-9) AS is_train
FROM events, range(4) b(boot)) WHERE is_train GROUP BY boot, event_type""")
def resample_stratified(spark, d):
    rows = resample.split(t(spark, d, "events").select("event_id", "event_type"), "event_id", 4, 0.8, SEED, "event_type").filter("is_train")
    return rows.groupBy(F.col("boot").cast("long").alias("boot"), "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(f"""SELECT boot, count(*) AS rows_drawn, sum(times)::BIGINT AS draws, sum(times * row_id)::BIGINT AS checksum FROM (
SELECT boot, {hash_sql('event_id', 'boot', SEED)} % (SELECT count(*) FROM events) AS row_id, count(*) AS times FROM events, range(5) b(boot) GROUP BY 1, 2) GROUP BY boot""")
def bootstrap_multiplicity(spark, d):
    m = resample.multiplicities(t(spark, d, "events"), "event_id", 5, SEED)
    return m.groupBy(F.col("boot").cast("long").alias("boot")).agg(F.count("*").alias("rows_drawn"), F.sum("times").alias("draws"), F.sum(F.col("times") * F.col("row_id")).alias("checksum"))


@query(f"SELECT boot, is_train, count(*) AS n, round(avg(y), 4) AS y_mean, round(avg(y * y) / 1e6, 4) AS yy FROM ({_SPLIT}) GROUP BY boot, is_train")
def gram_by_boot(spark, d):
    from sparsonde.operators import suffstats

    df = t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    p = np.zeros(0)
    rows = suffstats.boot_grams(fr.FeatureFrame(df, [], "o_totalprice", "o_orderkey"), fr.Stats(0, p, p, 0.0, 1.0, 0.0, 0.0), {"sel": (6, 0.9, SEED)}).collect()
    out = []
    for row in rows:
        for side in ("train", "test"):
            a = suffstats.parsed(row[side])
            out.append((row["boot"], side == "train", int(a[0, 0]), float(a[0, 1] / a[0, 0]), float(a[1, 1] / a[0, 0] / 1e6)))
    sums = spark.createDataFrame(out, "boot long, is_train boolean, n long, y_mean double, yy double")
    return sums.select("boot", "is_train", "n", r(F.col("y_mean"), "y_mean", 4), r(F.col("yy"), "yy", 4))


# regularisation paths

_TOP = "greatest(abs(covar_pop(l_quantity, l_extendedprice)), abs(covar_pop(l_discount, l_extendedprice)), abs(covar_pop(l_tax, l_extendedprice)))"


@query(f"SELECT i AS reg_idx, round(top * power(0.001, i / 11.0), 4) AS lambda FROM (SELECT {_TOP} AS top FROM lineitem), range(12) g(i)")
def lambda_grid_lasso(spark, d):
    g = grids.lambda_table(t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 12, 1e-3)
    return g.select(F.col("reg_idx").cast("long").alias("reg_idx"), r(F.col("lambda"), "lambda", 4))


@query(f"SELECT a.k * 12 + i AS reg_idx, a.ratio AS l1_ratio, round(top / a.ratio * power(0.001, i / 11.0), 4) AS lambda FROM (SELECT {_TOP} AS top FROM lineitem), range(12) g(i), (VALUES (0, 0.25::DOUBLE), (1, 0.5::DOUBLE)) a(k, ratio)")
def lambda_grid_enet(spark, d):
    names = ["l_quantity", "l_discount", "l_tax"]
    top = t(spark, d, "lineitem").agg(*[F.covar_pop(c, "l_extendedprice") for c in names]).first()
    rows = [(i, a, lam) for i, (lam, a) in enumerate(grids.elastic_net_grid(np.array(top), [0.25, 0.5], 12))]
    return spark.createDataFrame(rows, "reg_idx long, l1_ratio double, lambda double").select("reg_idx", "l1_ratio", r(F.col("lambda"), "lambda", 4))


@query("""WITH x AS (SELECT l_quantity AS x1, l_tax AS x2, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem), m AS (SELECT avg(y) AS p, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM x),
g AS (SELECT greatest(abs(avg((p - y) * (x1 - m1) / s1)), abs(avg((p - y) * (x2 - m2) / s2))) AS top FROM x, m) SELECT i AS reg_idx, round(ln(1 / (top * power(1e-5, i / 7.0))), 5) AS log_c FROM g, range(8) r(i)""")
def lambda_grid_logistic(spark, d):
    x = t(spark, d, "lineitem").select("l_quantity", "l_tax", (F.col("l_returnflag") == "R").cast("double").alias("y"))
    s = x.agg(F.covar_pop("l_quantity", "y") / F.stddev_pop("l_quantity"), F.covar_pop("l_tax", "y") / F.stddev_pop("l_tax")).first()
    rows = [(i, float(np.log(c))) for i, c in enumerate(grids.logistic_grid(np.array(s), 8))]
    return spark.createDataFrame(rows, "reg_idx long, log_c double").select("reg_idx", r(F.col("log_c"), "log_c", 5))


_LINES = "SELECT o_orderkey, o_totalprice / 1e5 AS x, count(l_orderkey)::DOUBLE AS y FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice"


def _lines(spark, d) -> DataFrame:
    """Lines per order: the lines are counted before the join."""
    n = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("double").alias("y"))
    return t(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1e5).alias("x")).join(n, "o_orderkey", "left").fillna(0.0, ["y"])


@query(f"SELECT i AS reg_idx, round(top / 0.5 * power(0.001, i / 7.0), 8) AS lambda FROM (SELECT abs(covar_pop(x, y)) AS top FROM ({_LINES})), range(8) g(i)")
def lambda_grid_poisson(spark, d):
    top = _lines(spark, d).agg(F.covar_pop("x", "y")).first()
    rows = [(i, lam) for i, (lam, _) in enumerate(grids.poisson_grid(np.array(top), [0.5], 8))]
    return spark.createDataFrame(rows, "reg_idx long, lambda double").select("reg_idx", r(F.col("lambda"), "lambda", 8))


# scalar functions


@query("SELECT event_id, round(sign(value - 50) * greatest(abs(value - 50) - 12.5, 0), 6) + 0.0 AS shrunk FROM events")
def soft_threshold(spark, d):
    return t(spark, d, "events").select("event_id", r(fn.soft_threshold(F.col("value") - 50, 12.5), "shrunk"))


@query("SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 8) AS p, round(CASE WHEN value >= 50 THEN -ln(1 + exp(-(value - 50) / 10)) ELSE (value - 50) / 10 - ln(1 + exp((value - 50) / 10)) END, 6) + 0.0 AS log_p FROM events")
def sigmoid(spark, d):
    z = (F.col("value") - 50) / 10
    return t(spark, d, "events").select("event_id", r(fn.sigmoid(z), "p", 8), r(fn.log_logistic(z), "log_p"))


@query("""SELECT vec_id, round(exp(embedding[1]::DOUBLE - top) / total, 6) AS p1, round(exp(embedding[2]::DOUBLE - top) / total, 6) AS p2, round(top + ln(total), 6) AS lse FROM (
SELECT vec_id, embedding, list_max(embedding)::DOUBLE AS top, list_sum(list_transform(embedding, lambda v: exp(v::DOUBLE - list_max(embedding)::DOUBLE))) AS total FROM embeddings)""")
def softmax(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    e = e.select("vec_id", fn.softmax(F.col("e")).alias("p"), r(fn.logsumexp(F.col("e")), "lse"))
    return e.select("vec_id", r(F.col("p")[0], "p1"), r(F.col("p")[1], "p2"), "lse")


@query(f"SELECT o_orderkey, round(exp(0.5 + 0.2 * x), 6) AS w, round(0.5 + 0.2 * x + y / exp(0.5 + 0.2 * x) - 1, 6) + 0.0 AS z FROM ({_LINES})")
def working_response(spark, d):
    eta = 0.5 + 0.2 * F.col("x")
    return _lines(spark, d).select("o_orderkey", r(fn.poisson_weight(eta), "w"), r(fn.poisson_response(eta, F.col("y")), "z"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)), 5) AS norm FROM embeddings")
def squared_norm(spark, d):
    return t(spark, d, "embeddings").select("vec_id", r(fn.squared_norm(F.col("embedding").cast("array<double>")), "norm", 5))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(100 + 20.5 * l_quantity - 300 * l_tax, 4) AS prediction FROM lineitem")
def predict_linear(spark, d):
    from .linear import LinearModel

    model = LinearModel(["l_quantity", "l_discount", "l_tax"], [20.5, 0.0, -300.0], 100.0)
    return model.transform(t(spark, d, "lineitem")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(F.col("prediction"), "prediction", 4))


@query("SELECT event_id, round(1 / (1 + exp(-(value - 50) / 20)), 6) AS p, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS prediction FROM events")
def predict_logistic(spark, d):
    from .glm import LogisticModel

    model = LogisticModel(["value"], np.array([[0.05]]), np.array([-2.5]), ["low", "high"])
    return model.transform(t(spark, d, "events")).select("event_id", r(F.col("probability")[1], "p"), "prediction")


@query(f"SELECT o_orderkey, round(exp(0.5 + 0.2 * x), 6) AS mean, floor(exp(0.5 + 0.2 * x))::BIGINT AS prediction FROM ({_LINES})")
def poisson_predict_mode(spark, d):
    from .glm import PoissonModel

    return PoissonModel(["x"], [0.2], 0.5).transform(_lines(spark, d)).select("o_orderkey", r(F.col("mean"), "mean"), "prediction")


# solvers in closed form


def _univariate_sql(ratio: float) -> str:
    """One standardised feature: the soft-thresholded correlation over 1 + lambda (1 - ratio)."""
    return f"""SELECT i AS reg_idx, round(CASE WHEN abs(c) > lam * {ratio} THEN sign(c) * (abs(c) - lam * {ratio}) / (1 + lam * {1 - ratio}) ELSE 0 END, 7) + 0.0 AS coef
FROM (SELECT corr(value, user_id) AS c FROM events), (SELECT i, 0.02 * power(0.5, i) AS lam FROM range(8) g(i))"""


def _univariate(spark, d, ratio: float) -> DataFrame:
    from sparsonde.operators import kernels

    c = t(spark, d, "events").agg(F.corr("value", "user_id")).first()[0]
    b = kernels.path(np.eye(1), np.array([c]), [(0.02 * 0.5**i, ratio) for i in range(8)], tol=1e-12)
    return spark.createDataFrame([(i, float(x[0])) for i, x in enumerate(b)], "reg_idx long, coef double").select("reg_idx", r(F.col("coef"), "coef", 7))


@query(_univariate_sql(1.0))
def lasso_univariate_path(spark, d):
    return _univariate(spark, d, 1.0)


@query(_univariate_sql(0.5))
def enet_univariate_path(spark, d):
    return _univariate(spark, d, 0.5)


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def ols_univariate(spark, d):
    from .linear import PathLasso

    m = PathLasso([0.0], tol=1e-14).fit(t(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(float(m.coef_[0][0]), float(m.intercept_[0]))], "slope double, intercept double").select(r(F.col("slope"), "slope", 4), r(F.col("intercept"), "intercept", 3))


@query("""WITH c AS (SELECT var_pop(l_quantity) AS a, covar_pop(l_quantity, l_tax) AS b, var_pop(l_tax) AS e, covar_pop(l_quantity, l_extendedprice) AS u, covar_pop(l_tax, l_extendedprice) AS v FROM lineitem)
SELECT round((u * e - b * v) / (a * e - b * b), 4) AS b_quantity, round((a * v - b * u) / (a * e - b * b), 2) AS b_tax FROM c""")
def ols_bivariate(spark, d):
    from sparsonde.operators import kernels

    df = t(spark, d, "lineitem")
    a, b, e, u, v = df.agg(F.var_pop("l_quantity"), F.covar_pop("l_quantity", "l_tax"), F.var_pop("l_tax"), F.covar_pop("l_quantity", "l_extendedprice"), F.covar_pop("l_tax", "l_extendedprice")).first()
    x = kernels.least_squares(np.array([[a, b], [b, e]]), np.array([u, v]))
    return spark.createDataFrame([(float(x[0]), float(x[1]))], "b_quantity double, b_tax double").select(r(F.col("b_quantity"), "b_quantity", 4), r(F.col("b_tax"), "b_tax", 2))


# selection

_COEFS = f"""SELECT boot, k.feature, i AS reg_idx, CASE WHEN abs(c) > 0.04 * power(0.7, i) THEN sign(c) * (abs(c) - 0.04 * power(0.7, i)) ELSE 0 END AS coef FROM (
SELECT boot, unnest([0, 1, 2]) AS feature, unnest([corr(user_id, value), corr(event_id % 97, value), corr((event_id * 7) % 1009, value)]) AS c FROM (
SELECT *, row_number() OVER (PARTITION BY boot ORDER BY {hash_sql('event_id', 'boot', SEED)}, event_id) > ceil((1 - 0.8) * count(*) OVER (PARTITION BY boot) - 1e-9) AS is_train FROM events, range(6) b(boot)) WHERE is_train GROUP BY boot) k, range(10) g(i)"""


def _coefs(spark, d) -> DataFrame:
    """(boot, reg_idx, feature, coef): one-feature lasso paths of three features on six resamples."""
    rows = resample.split(t(spark, d, "events").select("event_id", "user_id", "value"), "event_id", 6, 0.8, SEED).filter("is_train")
    features = [F.col("user_id"), F.col("event_id") % 97, (F.col("event_id") * 7) % 1009]
    c = rows.groupBy("boot").agg(*[F.corr(x.cast("double"), F.col("value")).alias(f"c{j}") for j, x in enumerate(features)])
    long = c.select("boot", F.posexplode(F.array("c0", "c1", "c2")).alias("feature", "c")).withColumn("reg_idx", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return long.select("boot", "reg_idx", "feature", fn.soft_threshold(F.col("c"), 0.04 * F.pow(F.lit(0.7), F.col("reg_idx"))).alias("coef"))


@query(f"SELECT reg_idx, feature::BIGINT AS feature, count(*) FILTER (WHERE coef <> 0) AS times FROM ({_COEFS}) GROUP BY reg_idx, feature")
def support_counts(spark, d):
    return stability.selection_counts(_coefs(spark, d)).select(F.col("reg_idx").cast("long").alias("reg_idx"), F.col("feature").cast("long").alias("feature"), "times")


_SUPPORTS = f"""SELECT DISTINCT support FROM (SELECT l.lim, reg_idx, string_agg(CASE WHEN times >= l.lim THEN '1' ELSE '0' END, '' ORDER BY feature) AS support
FROM (SELECT reg_idx, feature, count(*) FILTER (WHERE coef <> 0) AS times FROM ({_COEFS}) GROUP BY reg_idx, feature), (VALUES (6), (3)) l(lim) GROUP BY l.lim, reg_idx)"""


def _bits(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), "")


@query(f"SELECT row_number() OVER (ORDER BY support) - 1 AS support_id, support FROM ({_SUPPORTS})")
def stability_supports(spark, d):
    return stability.intersections(_coefs(spark, d), stability.thresholds([1.0, 0.5], 6)).select(F.col("support_id").cast("long").alias("support_id"), _bits("support").alias("support"))


@query(f"""WITH f AS (SELECT l.lim, reg_idx, feature, times >= l.lim AS sel FROM (SELECT reg_idx, feature, count(*) FILTER (WHERE coef <> 0) AS times FROM ({_COEFS}) GROUP BY reg_idx, feature), (VALUES (6), (3)) l(lim))
SELECT row_number() OVER (ORDER BY support) - 1 AS support_id, support FROM (SELECT DISTINCT support FROM (SELECT a.lim, a.reg_idx, string_agg(CASE WHEN a.sel OR b.sel THEN '1' ELSE '0' END, '' ORDER BY a.feature) AS support FROM f a JOIN f b ON a.lim = b.lim AND a.reg_idx = b.reg_idx AND b.feature = (a.feature + 1) % 3 GROUP BY a.lim, a.reg_idx))""")
def shared_supports(spark, d):
    """Two classes: the second's coefficients are those of the first's next feature."""
    c = _coefs(spark, d)
    both = c.unionByName(c.withColumn("feature", 3 + (F.col("feature") + 2) % 3))
    return stability.shared(stability.intersections(both, [6, 3]), 2).select(F.col("support_id").cast("long").alias("support_id"), _bits("support").alias("support"))


# intercepts


@query("SELECT round(avg(l_extendedprice), 4) AS linear, round(ln(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) / (1 - avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END))), 6) AS logistic, round(ln(avg(l_linenumber)), 6) AS poisson FROM lineitem")
def intercept_only(spark, d):
    from sparsonde.operators import kernels

    m = t(spark, d, "lineitem").agg(F.avg("l_extendedprice"), F.avg((F.col("l_returnflag") == "R").cast("double")), F.avg("l_linenumber")).first()
    row = [tuple(kernels.intercept_alone(x, f) for x, f in zip(m, ("linear", "logistic", "poisson"), strict=True))]
    return spark.createDataFrame(row, "linear double, logistic double, poisson double").select(r(F.col("linear"), "linear", 4), r(F.col("logistic"), "logistic"), r(F.col("poisson"), "poisson"))


@query("SELECT l_returnflag, round(ln(count(*) / sum(count(*)) OVER ()) - max(ln(count(*))) OVER () + ln(sum(count(*)) OVER ()), 6) + 0.0 AS intercept FROM lineitem GROUP BY l_returnflag")
def intercept_only_multinomial(spark, d):
    from sparsonde.operators import kernels

    rows = t(spark, d, "lineitem").groupBy("l_returnflag").count().orderBy("l_returnflag").collect()  # a row per class
    n = np.array([x["count"] for x in rows])
    b = kernels.intercept_alone(n / n.sum(), "multinomial")
    return spark.createDataFrame([(x["l_returnflag"], float(v)) for x, v in zip(rows, b, strict=True)], "l_returnflag string, b double").select("l_returnflag", r(F.col("b"), "intercept"))


@query(f"SELECT round(avg(y) - 0.3 * avg(x), 6) AS linear, round(ln(avg(y) / avg(exp(0.2 * x))), 6) AS poisson FROM ({_LINES})")
def final_intercept(spark, d):
    from .glm import DistributedPath

    df = _lines(spark, d)
    m = df.agg(F.avg("y"), F.avg("x")).first()
    _, linear = fr.restored(np.array([0.3]), m[0], np.array([m[1]]), np.ones(1))
    fit = DistributedPath("poisson", df, ["x"], "y", "o_orderkey", np.zeros(1), np.ones(1), True, 50, 1e-9)
    poisson = fit.final_intercept(np.array([0.2]))
    fit.df.unpersist()
    return spark.createDataFrame([(float(linear), poisson)], "a double, b double").select(r(F.col("a"), "linear"), r(F.col("b"), "poisson"))


# scores


@query("SELECT round(1 - sum(power(l_extendedprice - (1000 + 1500 * l_quantity), 2)) / (var_pop(l_extendedprice) * count(*)), 6) AS r2, round(-count(*) / 2.0 * (1 + ln(avg(power(l_extendedprice - (1000 + 1500 * l_quantity), 2)))) / count(*), 6) AS ll_per_row FROM lineitem")
def score_linear(spark, d):
    y, mu = F.col("l_extendedprice"), 1000 + 1500 * F.col("l_quantity")
    return t(spark, d, "lineitem").agg(r(fn.r2(y, mu), "r2"), r(fn.gaussian_ll(y, mu) / F.count("*"), "ll_per_row"))


@query(f"SELECT round(avg(CASE WHEN y = 0 THEN -mu ELSE y * ln(mu) - mu END), 6) AS ll FROM (SELECT y, exp(0.5 + 0.2 * x) AS mu FROM ({_LINES}))")
def poisson_ll(spark, d):
    return _lines(spark, d).agg(r(fn.poisson_ll(F.col("y"), F.exp(0.5 + 0.2 * F.col("x"))), "ll"))


@query("""WITH m AS (SELECT event_type, length(event_type) % 5 + 1 AS k, count(*) AS n, -count(*) / 2.0 * (1 + ln(var_pop(value))) AS ll FROM events GROUP BY event_type)
SELECT event_type, k::BIGINT AS k, n, round(2 * k - 2 * ll, 4) AS aic, round(2 * k - 2 * ll + CASE WHEN n > k + 1 THEN 2.0 * (k * k + k) / (n - k - 1) ELSE 0 END, 4) AS aicc, round(k * ln(n) - 2 * ll, 4) AS bic FROM m""")
def information_criteria(spark, d):
    """Of a model of each event type by its mean."""
    mean = F.avg("value").over(Window.partitionBy("event_type"))
    rows = t(spark, d, "events").select("event_type", "value", mean.alias("mu")).groupBy("event_type").agg(F.count("*").alias("n"), fn.gaussian_ll(F.col("value"), F.col("mu")).alias("ll")).withColumn("k", (F.length("event_type") % 5 + 1).cast("long"))
    return rows.select("event_type", "k", "n", r(fn.aic(F.col("ll"), F.col("k")), "aic", 4), r(fn.aicc(F.col("ll"), F.col("k"), F.col("n")), "aicc", 4), r(fn.bic(F.col("ll"), F.col("k"), F.col("n")), "bic", 4))


@query("SELECT round(avg(CASE WHEN (value > 50) = (user_id % 2 = 1) THEN 1.0 ELSE 0.0 END), 8) AS accuracy, round(-avg(CASE WHEN user_id % 2 = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss FROM (SELECT user_id, value, 1 / (1 + exp(-(value - 50) / 40)) AS p FROM events)")
def score_classes(spark, d):
    e = t(spark, d, "events").select((F.col("user_id") % 2).alias("y"), (F.col("value") > 50).cast("long").alias("label"), fn.sigmoid((F.col("value") - 50) / 40).alias("p"))
    return e.agg(r(fn.accuracy(F.col("y"), F.col("label")), "accuracy", 8), r(fn.log_loss(F.col("y"), F.col("p")), "log_loss"))


_SCORES = f"SELECT boot, s AS support_id, round(score, 1) AS score, score * 100 AS coef FROM (SELECT boot, s, avg(CASE WHEN {hash_sql('event_id', 'boot', SEED)} % 5 = s THEN value END) AS score FROM events, range(8) b(boot), range(5) g(s) GROUP BY boot, s)"


def _scores(spark, d) -> DataFrame:
    e = t(spark, d, "events").withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(7))))
    e = e.groupBy("boot", (resample.hash_column(F.col("event_id"), F.col("boot"), SEED) % 5).alias("support_id")).agg(F.avg("value").alias("score"))
    return e.select("boot", "support_id", F.round("score", 1).alias("score"), F.array(F.col("score") * 100).alias("coefs"))


@query(f"SELECT boot, support_id, score FROM (SELECT *, row_number() OVER (PARTITION BY boot ORDER BY score DESC, support_id) AS rn FROM ({_SCORES})) WHERE rn = 1")
def best_support_per_boot(spark, d):
    return stability.best_supports(_scores(spark, d)).select(F.col("boot").cast("long").alias("boot"), "support_id", "score")


@query(f"SELECT 0::BIGINT AS feature, round(median(coef), 5) AS coef FROM (SELECT *, row_number() OVER (PARTITION BY boot ORDER BY score DESC, support_id) AS rn FROM ({_SCORES})) WHERE rn = 1")
def median_union(spark, d):
    return stability.median_union(stability.best_supports(_scores(spark, d))).select(F.col("feature").cast("long").alias("feature"), r(F.col("coef"), "coef", 5))


# losses and gradients


@query("SELECT round(avg(ln(1 + exp(-s * z))), 6) AS loss, round(avg((1 / (1 + exp(-s * z)) - 1) * s * x), 6) AS g_x, round(avg((1 / (1 + exp(-s * z)) - 1) * s), 6) AS g_1 FROM (SELECT value / 100 AS x, 0.4 * value / 100 - 0.2 AS z, CASE WHEN user_id % 3 = 0 THEN 1 ELSE -1 END AS s FROM events)")
def logistic_loss_grad(spark, d):
    from sparsonde.operators import kernels, suffstats

    e = t(spark, d, "events").select((F.col("value") / 100).alias("x"), F.when(F.col("user_id") % 3 == 0, 1.0).otherwise(-1.0).alias("s"))
    value, g = suffstats.mean_loss(e, ["x", "s"], lambda v: kernels.logistic_loss(np.array([0.4, -0.2]), v[:, :1], v[:, 1]))
    return _losses(spark, [(value, *map(float, g))]).select("loss", "g_x", "g_1")


def _losses(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "a double, b double, c double").select(r(F.col("a"), "loss"), r(F.col("b"), "g_x"), r(F.col("c"), "g_1"))


@query("""SELECT k, round(avg(loss), 6) AS loss, round(avg((p - CASE WHEN y = k THEN 1 ELSE 0 END) * x), 6) + 0.0 AS g_x FROM (SELECT x, y, k, exp(w * x) / (exp(0.3 * x) + exp(-0.1 * x) + exp(0.5 * x)) AS p, CASE WHEN y = k THEN -ln(exp(w * x) / (exp(0.3 * x) + exp(-0.1 * x) + exp(0.5 * x))) ELSE 0 END AS loss
FROM (SELECT l_quantity / 50 AS x, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y FROM lineitem), (VALUES (0, 0.3), (1, -0.1), (2, 0.5)) c(k, w)) GROUP BY k""")
def multinomial_loss_grad(spark, d):
    from sparsonde.operators import kernels, suffstats

    x = t(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("x"), *fr.one_hot(F.col("l_returnflag"), ["A", "N", "R"]))
    w, out = np.array([[0.3, -0.1, 0.5]]), []
    for k in range(3):  # the loss of class k's rows, and the gradient of its coefficient
        own = np.eye(3)[k]
        value, _ = suffstats.mean_loss(x, ["x", "is_A", "is_N", "is_R"], lambda v, own=own: kernels.multinomial_loss(w, v[:, :1], v[:, 1:] * own))
        out.append(float(value))
    _, g = suffstats.mean_loss(x, ["x", "is_A", "is_N", "is_R"], lambda v: kernels.multinomial_loss(w, v[:, :1], v[:, 1:]))
    return spark.createDataFrame([(k, out[k], float(g[k])) for k in range(3)], "k int, a double, b double").select("k", r(F.col("a"), "loss"), r(F.col("b"), "g_x"))


@query(f"SELECT round(avg(mu - y * eta), 6) AS loss, round(avg((mu - y) * x), 6) AS g_x, round(avg(mu - y), 6) AS g_1 FROM (SELECT x, y, 0.5 + 0.2 * x AS eta, exp(0.5 + 0.2 * x) AS mu FROM ({_LINES}))")
def poisson_loss_grad(spark, d):
    from sparsonde.operators import kernels, suffstats

    value, g = suffstats.mean_loss(_lines(spark, d), ["x", "y"], lambda v: kernels.poisson_loss(np.array([0.2, 0.5]), v[:, :1], v[:, 1]))
    return _losses(spark, [(value, *map(float, g))])


# fits without penalty that have a closed form: one feature that tells two groups apart


@query("""SELECT round(ln(p0 / (1 - p0)), 4) AS intercept, round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 4) AS coef FROM (
SELECT avg(y) FILTER (WHERE g = 0) AS p0, avg(y) FILTER (WHERE g = 1) AS p1 FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS g FROM lineitem))""")
def logistic_two_groups(spark, d):
    from .glm import MaskedLogistic

    df = t(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") > 25).cast("double").alias("g"))
    m = MaskedLogistic(C=np.inf, tol=1e-9).fit(df, ["g"], "y")
    return spark.createDataFrame([(float(m.intercept_[0]), float(m.coef_[0, 0]))], "a double, b double").select(r(F.col("a"), "intercept", 4), r(F.col("b"), "coef", 4))


@query("""SELECT round(ln(m0), 4) AS intercept, round(ln(m1) - ln(m0), 4) AS coef FROM (
SELECT avg(y) FILTER (WHERE g = 0) AS m0, avg(y) FILTER (WHERE g = 1) AS m1 FROM (SELECT l_quantity AS y, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS g FROM lineitem))""")
def poisson_two_groups(spark, d):
    from .glm import PoissonGLM

    df = t(spark, d, "lineitem").select(F.col("l_quantity").alias("y"), (F.col("l_returnflag") == "R").cast("double").alias("g"))
    m = PoissonGLM(alpha=0.0, tol=1e-9).fit(df, ["g"], "y")
    return spark.createDataFrame([(float(m.intercept_), float(m.coef_[0]))], "a double, b double").select(r(F.col("a"), "intercept", 4), r(F.col("b"), "coef", 4))


@query("""WITH c AS (SELECT l_returnflag AS flag, ln(count(*) FILTER (WHERE l_discount > 0.05)) AS one, ln(count(*) FILTER (WHERE l_discount <= 0.05)) AS zero FROM lineitem GROUP BY l_returnflag)
SELECT flag, round(zero - avg(zero) OVER (), 4) AS intercept, round(one - zero - avg(one - zero) OVER (), 4) AS coef FROM c""")
def multinomial_two_groups(spark, d):
    """Of distributed rows; coefficients and intercepts of all classes add up to 0."""
    from sparsonde.operators import families
    from sparsonde.operators.design import Design

    from .lockstep import LockstepFit

    df = fr.encoded(t(spark, d, "lineitem"), "l_returnflag", "y").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "y", (F.col("l_discount") > 0.05).cast("double").alias("g"), "l_returnflag")
    flags = [x[0] for x in df.select("l_returnflag").distinct().orderBy("l_returnflag").collect()]
    fit = LockstepFit(families.Multinomial(len(flags)), df, Design(["g"]), "y", "id", True, 500, 1e-8)
    fit.prepare()
    w = fit.solve({(0,): fit.start}, {(0,): (0.0, 1.0)}, {}, SEED, 1.0)[(0,)]
    fit.close()
    w = w - w.mean(axis=0)
    return spark.createDataFrame([(f, float(b), float(c)) for f, (c, b) in zip(flags, w, strict=True)], "flag string, b double, c double").select("flag", r(F.col("b"), "intercept", 4), r(F.col("c"), "coef", 4))


@query("""SELECT feature, round(ln(avg(y) / (1 - avg(y))), 4) AS coef FROM (SELECT (user_id % 7)::INTEGER AS feature, CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END AS y FROM events) GROUP BY feature""")
def sparse_logistic_groups(spark, d):
    """A sparse design from long entries: each event has one feature, its user's group."""
    from sparsonde.operators import families
    from sparsonde.operators.design import Design, sparse_rows

    from .lockstep import LockstepFit

    entries = t(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 7).alias("feature"), F.lit(1.0).alias("value"), (F.col("value") > 30).cast("int").alias("y"))
    rows = sparse_rows(entries, "id", "feature", "value", entries.select("id", "y"))
    fit = LockstepFit(families.Logistic(), rows, Design(indices="indices", values="values", p=7), "y", "id", False, 500, 1e-8)
    fit.prepare()
    w = fit.solve({(0,): fit.start}, {(0,): (0.0, 1.0)}, {}, SEED, 1.0)[(0,)]
    fit.close()
    return spark.createDataFrame([(j, float(c)) for j, c in enumerate(w[0, :7])], "feature int, c double").select("feature", r(F.col("c"), "coef", 4))


# decomposition

#: The first right singular vector of two columns has a closed form.
_PAIR = """SELECT unnest([0::BIGINT, 1::BIGINT]) AS j, unnest([b * b / (b * b + (l - a) * (l - a)), (l - a) * (l - a) / (b * b + (l - a) * (l - a))]) AS lev FROM (
SELECT a, b, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l FROM (SELECT sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS c FROM (SELECT embedding[3]::DOUBLE AS x, embedding[8]::DOUBLE AS y FROM embeddings)))"""


def _first_vector(spark, d) -> np.ndarray:
    from .decomposition import singular_vectors

    pair = t(spark, d, "embeddings").select(F.col("embedding")[2].cast("double").alias("x"), F.col("embedding")[7].cast("double").alias("y"))
    return singular_vectors(pair, ["x", "y"], 1)


@query(f"SELECT j::BIGINT AS j, round(lev, 6) AS leverage FROM ({_PAIR})")
def leverage_scores(spark, d):
    from .decomposition import leverage

    return spark.createDataFrame([(j, float(x)) for j, x in enumerate(leverage(_first_vector(spark, d)))], "j long, x double").select("j", r(F.col("x"), "leverage"))


@query(f"SELECT j::BIGINT AS j FROM ({_PAIR}) WHERE {hash_sql('j', '1', SEED)} / 2147483647.0 < least(1, 1.5 * lev)")
def column_select(spark, d):
    from .decomposition import column_select as draw

    return spark.createDataFrame([(int(j),) for j in sorted(draw(_first_vector(spark, d), 1.5, SEED))], "j long")


@query("""SELECT round(sum(v * v), 6) AS total, 64 AS p FROM (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings)""")
def singular_values_sum(spark, d):
    """All squared singular values together are the sum of squares, whatever way finds them."""
    from .decomposition import range_svd

    df, names = _wide(spark, d)
    _, values = range_svd(df, names, len(names), n_iter=1, seed=SEED)
    return spark.createDataFrame([(float((values**2).sum()), len(values))], "x double, p int").select(r(F.col("x"), "total"), "p")


@query("SELECT DISTINCT j FROM (SELECT k, j FROM (SELECT DISTINCT user_id % 5 AS boot, event_id % 3 AS k, event_id % 40 AS j FROM events WHERE value > 60) GROUP BY k, j HAVING count(*) >= 5)")
def column_consensus(spark, d):
    from .decomposition import chosen_columns

    flags = t(spark, d, "events").filter("value > 60").select((F.col("user_id") % 5).alias("boot"), (F.col("event_id") % 3).alias("k"), (F.col("event_id") % 40).alias("j")).distinct()
    return chosen_columns(flags, 5)


_BASES = """SELECT label, comp, list(m ORDER BY j) AS h FROM (SELECT label, vec_id % 4 AS comp, j, avg(abs(v)) AS m FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS j FROM embeddings) GROUP BY 1, 2, 3) GROUP BY label, comp"""


def _bases(spark, d) -> dict[int, np.ndarray]:
    """Four bases of each label: the mean sizes of all its vectors' entries, dealt by vec_id."""
    e = t(spark, d, "embeddings").select("label", (F.col("vec_id") % 4).alias("comp"), F.posexplode("embedding").alias("j", "v"))
    m = e.groupBy("label", "comp", "j").agg(F.avg(F.abs(F.col("v").cast("double"))).alias("m"))
    rows = m.groupBy("label", "comp").agg(F.array_sort(F.collect_list(F.struct("j", "m"))).alias("h")).orderBy("label", "comp").select("label", F.col("h.m").alias("h")).collect()  # four rows per label
    out: dict[int, list] = {}
    for x in rows:
        out.setdefault(x["label"], []).append(x["h"])
    return {k: np.array(v) for k, v in out.items()}


_DISSIMILARITY = f"""SELECT la, lb, 1 - (sum(ra) / 2 + sum(rb) / 2) / 4 AS apart FROM (SELECT la, lb, sum(m) AS ra, 0.0 AS rb FROM (SELECT a.label AS la, b.label AS lb, a.comp AS k, max(list_cosine_similarity(a.h, b.h)) AS m FROM ({_BASES}) a JOIN ({_BASES}) b ON a.label < b.label GROUP BY a.label, b.label, a.comp) GROUP BY la, lb
UNION ALL SELECT la, lb, 0.0, sum(m) FROM (SELECT a.label AS la, b.label AS lb, b.comp AS k, max(list_cosine_similarity(a.h, b.h)) AS m FROM ({_BASES}) a JOIN ({_BASES}) b ON a.label < b.label GROUP BY a.label, b.label, b.comp) GROUP BY la, lb) GROUP BY la, lb"""


def _dissimilarities(spark, d) -> list[tuple[int, int, float]]:
    from sparsonde.operators import kernels

    bases = _bases(spark, d)
    return [(a, b, kernels.dissimilarity(bases[a], bases[b])) for a in bases for b in bases if a < b]


@query(f"SELECT la, lb, round(apart, 6) AS apart FROM ({_DISSIMILARITY})")
def basis_dissimilarity(spark, d):
    return spark.createDataFrame(_dissimilarities(spark, d), "la int, lb int, apart double").select("la", "lb", r(F.col("apart"), "apart"))


@query(f"SELECT la AS rank FROM (SELECT la, avg(apart) AS a FROM ({_DISSIMILARITY}) GROUP BY la ORDER BY round(a, 9), la LIMIT 1)")
def rank_choice(spark, d):
    from .decomposition import choose_rank

    of: dict[int, list[float]] = {}
    for a, _, x in _dissimilarities(spark, d):
        of.setdefault(a, []).append(x)
    return spark.createDataFrame([(int(choose_rank([round(float(np.mean(x)), 9) for x in of.values()], list(of))),)], "rank int")


@query(f"""SELECT label, j, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS v FROM (SELECT label, j, avg(u) AS m FROM (SELECT label, unnest(range(len(h))) AS j, unnest(list_transform(h, lambda v: v / sqrt(list_sum(list_transform(h, lambda w: w * w))))) AS u FROM ({_BASES})) GROUP BY label, j)""")
def consensus_bases(spark, d):
    from .decomposition import consensus, unit_bases

    bases = _bases(spark, d)
    labels = np.concatenate([np.full(len(h), k) for k, h in bases.items()])
    means = consensus(unit_bases(np.vstack(list(bases.values()))), labels)
    rows = [(int(k), j, float(v)) for k, mean in zip(sorted(bases), means, strict=True) for j, v in enumerate(mean)]
    return spark.createDataFrame(rows, "label int, j long, x double").select("label", "j", r(F.col("x"), "v"))


@query("""WITH RECURSIVE e AS (SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON abs(a.s_acctbal - b.s_acctbal) <= 40),
core AS (SELECT x FROM e GROUP BY x HAVING count(*) >= 3), links AS (SELECT e.x, e.y FROM e JOIN core c ON c.x = e.x JOIN core k ON k.x = e.y),
reach(x, c) AS (SELECT x, x FROM core UNION SELECT l.y, r.c FROM reach r JOIN links l ON l.x = r.x), comp AS (SELECT x, min(c) AS c FROM reach GROUP BY x),
every AS (SELECT s_suppkey AS x, coalesce(comp.c, (SELECT min(k.c) FROM e JOIN comp k ON k.x = e.y WHERE e.x = s_suppkey)) AS c FROM supplier LEFT JOIN comp ON comp.x = s_suppkey)
SELECT x AS s_suppkey, coalesce(c, -1) AS cluster FROM every""")
def dbscan_components(spark, d):
    return density.dbscan(t(spark, d, "supplier"), "s_suppkey", "s_acctbal", 40.0, 3)


_COUNTS = "SELECT u.user_id, k.k, (SELECT count(*) FROM events e WHERE e.user_id = u.user_id AND e.event_type = k.event_type)::DOUBLE AS x FROM (SELECT DISTINCT user_id FROM events) u, (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM events)) k"


def _counts(spark, d) -> tuple[DataFrame, list[str]]:
    """Events of each type per user."""
    e = t(spark, d, "events")
    names = [x[0] for x in e.select("event_type").distinct().orderBy("event_type").collect()]  # a row per type
    return e.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == n).cast("double").alias(f"x{k}") for k, n in enumerate(names)]), [f"x{k}" for k in range(len(names))]


@query(f"SELECT user_id, round(greatest(0, sum(x / (1.0 + k)) / sum(1 / ((1.0 + k) * (1.0 + k)))), 6) AS w FROM ({_COUNTS}) GROUP BY user_id")
def nnls_single_component(spark, d):
    from .decomposition import NMFModel

    df, names = _counts(spark, d)
    out = NMFModel(names, np.array([[1 / (1.0 + k) for k in range(len(names))]])).transform(df)
    return out.select("user_id", r(F.col("weights")[0], "w"))


@query(f"SELECT user_id, round(sum(x / (1.0 + k)), 6) AS y0, round(sum(x * 0.1 * (k + 1)), 6) AS y1 FROM ({_COUNTS}) GROUP BY user_id")
def nmf_reconstruct(spark, d):
    from .decomposition import NMFModel

    df, names = _counts(spark, d)
    model = NMFModel(["a", "b"], np.array([[1 / (1.0 + k), 0.1 * (k + 1)] for k in range(len(names))]))
    out = model.inverse_transform(df.withColumn("weights", F.array(*names)))
    return out.select("user_id", r(F.col("reconstructed")[0], "y0"), r(F.col("reconstructed")[1], "y1"))


# whole models: no SQL, rows only


def _priced(spark, d) -> DataFrame:
    """Orders with a synthetic price of their lines' sums, so that there is something to find."""
    names = ["l_quantity", "l_discount", "l_tax"]
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(*[F.sum(c).alias(c) for c in names], F.sum("l_extendedprice").alias("price"))
    return lines


@query()
def stable_lasso(spark, d):
    from .linear import StableLasso

    df = _priced(spark, d)
    return StableLasso(random_state=SEED, n_lambdas=24).fit(df, ["l_quantity", "l_discount", "l_tax"], "price", "row_id").table(spark)


@query()
def stable_wide_lasso(spark, d):
    """All 2,080 products of two components of a vector, in one array column."""
    from sparsonde.operators.design import Design

    from .linear import StableLasso

    v = F.col("embedding")
    products = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.transform(F.slice(v, i + 1, F.lit(64)), lambda x: (x * F.element_at(v, i + 1)).cast("double") * 64)))
    df = t(spark, d, "embeddings").select("vec_id", products.alias("v"), (F.element_at(v, 3) * F.element_at(v, 9) * 64 + F.element_at(v, 5) * F.element_at(v, 5) * 64 + F.col("label") / 10).cast("double").alias("y"))
    model = StableLasso(n_boots_sel=6, n_boots_est=6, n_lambdas=8, eps=0.2, random_state=SEED, estimation_score="BIC").fit(df, Design(vector="v", p=2080), "y", "vec_id")
    return model.table(spark).filter("selected")


@query()
def stable_elastic_net(spark, d):
    from .linear import StableElasticNet

    df = _priced(spark, d)
    return StableElasticNet(random_state=SEED, n_lambdas=16, alphas=(0.3, 0.9), estimation_score="BIC").fit(df, ["l_quantity", "l_discount", "l_tax"], "price", "row_id").table(spark)


def _wide(spark, d, p: int = 64) -> tuple[DataFrame, list[str]]:
    e = tables.vector_columns(t(spark, d, "embeddings"), "embedding", "e", p)
    return e, [f"e{j}" for j in range(p)]


def _coefficients(spark, model) -> DataFrame:
    rows = [(k, f, float(c)) for k, row in enumerate(np.atleast_2d(model.coef_)) for f, c in zip(model.features, row, strict=True)]
    return spark.createDataFrame(rows, "output int, feature string, coef double")


@query()
def stable_logistic(spark, d):
    from .glm import StableL1Logistic

    df, names = _wide(spark, d)
    df = df.withColumn("y", (F.col("label") < 3).cast("int"))
    return _coefficients(spark, StableL1Logistic(n_boots_sel=8, n_boots_est=8, n_C=8, random_state=SEED).fit(df, names, "y", "vec_id"))


@query()
def stable_multinomial(spark, d):
    from .glm import StableL1Logistic

    df, names = _wide(spark, d)
    return _coefficients(spark, StableL1Logistic(n_boots_sel=4, n_boots_est=4, n_C=4, multi_class="multinomial", random_state=SEED).fit(df, names, "label", "vec_id"))


@query()
def distributed_multinomial(spark, d):
    from .glm import StableL1Logistic

    df, names = _wide(spark, d)
    return _coefficients(spark, StableL1Logistic(n_boots_sel=4, n_boots_est=4, n_C=4, multi_class="multinomial", eps=0.1, max_iter=300, random_state=SEED, block_mb=0).fit(df, names, "label", "vec_id"))


@query()
def stable_poisson(spark, d):
    from .glm import StablePoisson

    df = _lines(spark, d).withColumn("x2", F.col("o_orderkey") % 7)
    return _coefficients(spark, StablePoisson(n_boots_sel=8, n_boots_est=8, n_lambdas=10, random_state=SEED).fit(df, ["x", "x2"], "y", "o_orderkey"))


@query()
def distributed_poisson(spark, d):
    from .glm import StablePoisson

    df = _lines(spark, d).withColumn("x2", F.col("o_orderkey") % 7)
    return _coefficients(spark, StablePoisson(n_boots_sel=4, n_boots_est=4, n_lambdas=3, random_state=SEED, block_mb=0).fit(df, ["x", "x2"], "y", "o_orderkey"))


@query()
def stable_columns(spark, d):
    from .decomposition import StableColumns

    df, names = _wide(spark, d)
    model = StableColumns(6, 8, 0.8, 0.5, random_state=SEED).fit(df, names, ks=[4, 8], cs=[10, 12], id_col="vec_id")
    return spark.createDataFrame([(c,) for c in model.columns_], "column string")


@query()
def stable_nmf(spark, d):
    from .decomposition import StableNMF

    e = t(spark, d, "events")
    names = [x[0] for x in e.select("event_type").distinct().orderBy("event_type").collect()]
    x = e.groupBy("user_id").pivot("event_type", names).agg(F.sum("value")).fillna(0.0)
    model = StableNMF(n_boots=6, ranks=3, random_state=SEED, nmf_max_iter=150).fit(x, names, "user_id")
    return model.transform(x, error="squared_error").select("user_id", "weights", "squared_error")


@query()
def synthetic_data(spark, d):
    from sparsonde.sources import datasets

    n = t(spark, d, "orders").count()  # as many rows of each kind
    a = datasets.linear_regression(spark, n, random_state=3)[0].agg(F.count("*").alias("n"), F.avg("y").alias("y")).withColumn("kind", F.lit("linear"))
    b = datasets.classification(spark, n, n_classes=3, random_state=3)[0].agg(F.count("*").alias("n"), F.avg("y").alias("y")).withColumn("kind", F.lit("classes"))
    c = datasets.poisson_regression(spark, n, random_state=3)[0].agg(F.count("*").alias("n"), F.avg("y").alias("y")).withColumn("kind", F.lit("counts"))
    return a.unionByName(b).unionByName(c)
