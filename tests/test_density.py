import numpy as np
import pytest

from sparsonde.operators import density, kernels


def brute(ids, x, eps, least):
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    label = kernels.dbscan(x[:, None], eps, least)
    core = (np.abs(x[:, None] - x) <= eps).sum(1) >= least
    first = {c: int(ids[(label == c) & core].min()) for c in set(label.tolist()) - {-1}}
    return {int(i): first.get(int(c), -1) for i, c in zip(ids, label, strict=True)}


@pytest.mark.parametrize(("eps", "least", "width"), [(2.0, 3, 400), (3.0, 1, 5000), (5.0, 6, 9000)])
def test_equals_all_pairs(spark, eps, least, width):
    rng = np.random.default_rng(width)
    x = np.concatenate([rng.integers(-width, width, 500), np.full(250, 7)]).astype(float)  # a third of the rows share a value
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), float(v)) for i, v in zip(ids, x, strict=True)], "id long, x double").repartition(3)
    got = {r["id"]: r["cluster"] for r in density.dbscan(df, "id", "x", eps, least).collect()}
    assert got == brute(ids, x, eps, least)


def test_odd_values(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, float("inf")), (4, 0.0), (5, 0.5), (6, 9.0)], "id long, x double")
    assert {r["id"]: r["cluster"] for r in density.dbscan(df, "id", "x", 1.0, 2).collect()} == {1: -1, 2: -1, 3: -1, 4: 4, 5: 4, 6: -1}
    assert density.dbscan(df.limit(0), "id", "x", 1.0, 2).count() == 0
    assert {r["cluster"] for r in density.dbscan(df.filter("id < 4"), "id", "x", 1.0).collect()} == {-1}
    with pytest.raises(ValueError):
        density.dbscan(df, "id", "x", 0.0)
