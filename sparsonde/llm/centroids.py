"""Centroid clustering with weighted deduplication: Lloyd's rounds on distinct integer vectors.

Vectors become integers, equal ones are one row with a multiplicity, and that table is what the rounds read: each is one pass in
which a task assigns its rows and adds times * vector per centroid, so a task sends centroids * (dimensions + 1) integers. All
sums are exact. The assignment of each distinct vector is joined back to the ids: the few vectors that hold a large share of all
rows are broadcast (at most ``HOT``), the rest meets in a shuffled join in which no key is frequent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, vectors

#: A vector with more than one in HOT of all rows is broadcast; there are fewer than HOT such vectors.
HOT = 4096


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (of equally near ones the first) and its squared distance."""
    apart = (x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1)[None, :] - 2 * vectors.products(x, centroids)
    best = apart.argmin(axis=1)
    return best, apart[np.arange(len(x)), best]


def _sums(distinct: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """Of each centroid's vectors the sum by component, and at component -1 their number."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), object)
        for batch in batches:
            x, times = vectors.matrix(batch.column("q"), width), batch.column("times").to_numpy()
            best, _ = nearest(x, centroids)
            whole = np.column_stack([x, np.ones(len(x), np.int64)])
            if int(np.abs(whole).max(initial=0)) * int(times.sum()) >= 1 << 62:
                whole, times = whole.astype(object), times.astype(object)
            for c in np.unique(best):
                at = best == c
                total[c] += (whole[at] * times[at][:, None]).sum(axis=0)
        c, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel(), pa.int32()), pa.array(np.where(j == width, -1, j).ravel(), pa.int32()), pa.array([str(v) for v in total.ravel()])], ["c", "j", "v"])

    rows = distinct.mapInArrow(run, "c int, j int, v string").groupBy("c", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # centroids * (dimensions + 1) rows
    return {(r["c"], r["j"]): int(r["v"]) for r in rows}


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(rows: DataFrame, clusters: int = 16, rounds: int = 3, scale: int = 64, width: int = 64, seed: int = 1, id_col: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(``id_col``, cluster, distance, cluster_inertia, inertia) of every usable row, and the final centroids.

    Rows whose vector is null, isn't of ``width`` components or holds a null or a number that isn't finite are left out. Components
    become floor(scale * x), held within +-2**27 for 64 dimensions, so that distances fit 64 bits (sums of them that don't are null).
    The first centroids are the vectors of the ``clusters`` rows with the smallest sha256 of ``seed:id`` (of equal ones the
    smaller id, then vector; a null id comes last); fewer rows give fewer centroids, an empty table none. Repeated rows all count.
    """
    spark = rows.sparkSession
    most = vectors.bound(width, 60)
    kept = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).filter((F.size("v") == width) & vectors.usable(F.col("v"))).select("id", vectors.quantised(F.col("v"), scale, most).alias("q"))
    kept = kept.withColumn("h", F.xxhash64("q"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.select(order.alias("o"), "id", "q").orderBy(F.col("o").asc_nulls_last(), F.col("id").asc_nulls_last(), "q").limit(clusters).collect()  # a row per centroid
    centroids = np.array([r["q"] for r in first], np.int64).reshape(len(first), width)
    distinct = store.written(kept.groupBy("h", "q").agg(F.count("*").alias("times")), "distinct-vectors")
    for _ in range(rounds if len(first) else 0):
        sums = _sums(distinct, centroids)
        centroids = np.array([[sums[c, j] // n for j in range(width)] if (n := sums.get((c, -1), 0)) else old.tolist() for c, old in enumerate(centroids)], np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, apart = nearest(vectors.matrix(batch.column("q"), width), centroids) if len(centroids) else (np.zeros(0, int), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("q"), batch.column("times"), pa.array(best, pa.int32()), pa.array(apart, pa.int64())], ["h", "q", "times", "cluster", "distance"])

    given = store.written(distinct.mapInArrow(assign, "h long, q array<int>, times long, cluster int, distance long"), "assigned-vectors")
    each = given.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("times")).alias("d"), F.sum("times").alias("n")).collect()  # a row per centroid
    total, inertia = sum(r["n"] for r in each), sum(int(r["d"]) for r in each)
    fits = lambda v: v if v < 1 << 63 else None
    about = spark.createDataFrame([(r["cluster"], fits(int(r["d"])), fits(inertia)) for r in each], "c int, cluster_inertia long, inertia long")
    hot = given.filter(F.col("times") > total / HOT).select(F.col("h").alias("hh"), F.col("q").alias("hq"), F.col("cluster").alias("hc"), F.col("distance").alias("hd"))
    found = kept.join(F.broadcast(hot), (F.col("h") == F.col("hh")) & (F.col("q") == F.col("hq")), "left")
    # A row that has its answer goes anywhere in the join that the others need: its key is its own, and matches nothing.
    done = F.col("hh").isNotNull()
    found = found.select("id", "hc", "hd", F.when(done, F.xxhash64("id")).otherwise(F.col("h")).alias("h"), F.when(done, F.array().cast("array<int>")).otherwise(F.col("q")).alias("q"))
    found = found.join(given.select("h", "q", "cluster", "distance"), ["h", "q"], "left").select("id", F.coalesce("hc", "cluster").alias("cluster"), F.coalesce("hd", "distance").alias("distance"))
    out = found.join(F.broadcast(about), found["cluster"] == about["c"]).select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia")
    return out, centroids


def digested(rows: DataFrame, **more) -> DataFrame:
    """As ``cluster``, with ``centroid_sha256``: of the final centroid's components as decimal numbers joined by commas."""
    out, centroids = cluster(rows, **more)
    names = F.element_at(F.array(*[F.lit(digest(c)) for c in centroids]), F.col("cluster") + 1) if len(centroids) else F.lit(None).cast("string")
    return out.withColumn("centroid_sha256", names)
