"""Clustering and search of vectors against plain Python, on odd rows."""

import hashlib
import math
import random

import pytest

from sparsonde.llm import centroids, topk, vectors

from .conftest import CLASHING


def _rows(width=6, n=240, seed=4):
    """A third of all rows one vector, some ties, and vectors that take no part."""
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(width)]) for i in range(n)]
    rows += [(n + i, [0.5, -0.25, 0.125, 0.75, 0.0, -1.0][:width]) for i in range(n // 2)]
    rows += [(1000 + i, [float(rng.randrange(-1, 2)) for _ in range(width)]) for i in range(40)]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None), (2001, []), (2002, [nan, *[0.0] * (width - 1)]), (2003, [inf] * width), (2004, [None] * width), (2005, [1.0] * (width - 1)), (None, [0.25] * width), (2100, [40000.0] + [-3.0] * (width - 1)), (100, [0.5] * width)]
    return rows


def _table(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(7).alias(c) for c in [*CLASHING, "q", "id", "cluster", "c", "score", "rank", "l0", "asks"]]).repartition(5)


def _ok(v, width=None):
    return v is not None and (width is None or len(v) == width) and all(x is not None and math.isfinite(x) for x in v)


def _lloyd(rows, k, rounds, scale, width, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if _ok(v, width)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))[:k]
    cs = [list(v) for _, v in first]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(cs)), key=lambda j: (apart(v, cs[j]), j))
    for _ in range(rounds):
        of = [near(v) for _, v in kept]
        cs = [[sum(v[d] for (_, v), o in zip(kept, of, strict=True) if o == j) // of.count(j) for d in range(width)] if j in of else cs[j] for j in range(len(cs))]
    of = [(i, near(v), apart(v, cs[near(v)])) for i, v in kept]
    return [(i, c, d, sum(y for _, x, y in of if x == c), sum(y for _, _, y in of), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in of]


@pytest.mark.parametrize("hot", [2, 4096])
def test_clusters_equal_plain_lloyd(spark, monkeypatch, hot):
    monkeypatch.setattr(centroids, "HOT", hot)
    rows = _rows()
    got = centroids.digested(_table(spark, rows), clusters=7, rounds=3, scale=16, width=6, seed=3)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(_lloyd(rows, 7, 3, 16, 6, 3), key=key)


def test_clusters_of_few_and_no_rows(spark):
    rows = [(5, [0.5, 0.25]), (5, [0.5, 0.25]), (9, [1.0, -1.0])]
    got = centroids.digested(_table(spark, rows), clusters=16, rounds=2, scale=8, width=2, seed=1)
    assert sorted(map(tuple, got.collect())) == sorted(_lloyd(rows, 16, 2, 8, 2, 1))
    empty = centroids.digested(_table(spark, [(1, None), (2, [0.5])]), width=2)
    assert empty.columns == got.columns and empty.count() == 0


def test_a_pass_adds_up_multiplicities(spark):
    rows = [(i, [0.5, 0.25]) for i in range(50)] + [(50, [1.0, 1.0])]
    out, final = centroids.cluster(_table(spark, rows), clusters=1, rounds=1, scale=4, width=2)
    assert final.tolist() == [[(50 * 2 + 4) // 51, (50 * 1 + 4) // 51]] and out.count() == 51


def test_large_components_stay_exact():
    import numpy as np

    a, b = np.array([[1 << 27, -(1 << 27) + 1], [3, -5]]), np.array([[(1 << 27) - 1, 7]])
    assert vectors.products(a, b).tolist() == [[(1 << 27) * ((1 << 27) - 1) - 7 * ((1 << 27) - 1)], [3 * ((1 << 27) - 1) - 35]]


def _search(rows, asks, k, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if _ok(v)]
    width = max((len(v) for _, v in kept), default=0)
    kept = [(i, v + [0] * (width - len(v))) for i, v in kept]
    queries = {}
    for i, v in kept:
        if i is not None and asks(i):
            queries[i] = min(v, queries.get(i, v))
    out = []
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i if i is not None else topk.NO_ID) for i, x in kept if i != q)
        out += [(q, r + 1, None if i == topk.NO_ID else i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize(("lists", "block", "rows_at_once", "held"), [(1, 1024, 2048, 1 << 19), (2, 3, 7, 5), (4, 1024, 50, 5), (9, 10, 2048, 1 << 19)])
def test_search_equals_all_pairs(spark, monkeypatch, lists, block, rows_at_once, held):
    from pyspark.sql import functions as F

    monkeypatch.setattr(topk, "ROWS", rows_at_once)
    monkeypatch.setattr(topk, "HELD", held)
    rows = _rows()
    got = topk.top_k(_table(spark, rows), F.col("vec_id") % 20 == 0, k=10, scale=32, lists=lists, block=block)
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(_search(rows, lambda i: i % 20 == 0, 10, 32), key=key)


def test_search_among_few_and_no_rows(spark):
    from pyspark.sql import functions as F

    rows = [(0, [0.5]), (100, [-0.5, 1.0]), (7, [1.0, 1.0])]
    got = topk.top_k(_table(spark, rows), F.col("vec_id") % 100 == 0, k=10, scale=4)
    assert sorted(map(tuple, got.collect())) == sorted(_search(rows, lambda i: i % 100 == 0, 10, 4))
    for few in ([(1, None)], [(1, [0.5])], [(0, [0.5])]):
        assert topk.top_k(_table(spark, few), F.col("vec_id") % 100 == 0).count() == 0


def test_cutoffs_let_most_entries_go(spark):
    """Of random unit vectors few entries reach the cutoff; all that are among the best do."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 64))
    x = np.floor(1024 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    lists, ids = [x[:8, :32], x[:8, 32:]], np.arange(8)
    floors = np.sort(np.where(np.eye(8, 4000, dtype=bool), topk.NONE, x[:8] @ x.T), axis=1)[:, -10]
    table = spark.createDataFrame([(i, r[:32].tolist(), r[32:].tolist()) for i, r in enumerate(x)], "id long, l0 array<int>, l1 array<int>").repartition(4)
    low = topk._floors(table, ids, lists, [32, 32], 10)
    assert (low <= floors).all() and (low > floors / 2).all()
    found = topk._collected(table, ids, lists, [32, 32], low, 10).groupBy("query_id").count().collect()
    assert all(10 <= r["count"] <= 40 for r in found) and len(found) == 8
