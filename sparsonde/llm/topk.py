"""Exact top-k search by inner product: the three-phase uniform threshold.

A vector's components are dealt to ``lists`` blocks, columns of one table, and a pair's score is the sum of its local scores,
one of each block. A block of queries takes two passes over the table:

1. every task gathers the heads of its local score lists, whose whole scores it knows; the k-th best of all tasks' is a floor
   under the query's k-th score.
2. floor / lists is broadcast as the cutoff: a score of at least the floor has a local score of at least the cutoff in some
   list, whatever the signs. Each task collects the entries at or above it in any list.
3. the rest of a collected entry's score is added where its row lies; what reaches the floor goes on, at most k a task and
   query (in the final order, so nothing is lost), and Spark ranks those.

Queries come in blocks of ``block``, so that what is broadcast has that bound; floors are a number per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store, vectors

#: Queries of one pass, and rows whose scores with them are held at once.
BLOCK, ROWS = 1024, 2048
#: Stands for a null id: after all others.
NO_ID = (1 << 63) - 1
#: Below all scores.
NONE = -(1 << 62)
#: Entries that a task holds at least before it lets go of those that can't be among the best.
HELD = 1 << 19


def _slices(batches: Iterator[pa.RecordBatch], widths: list[int], lists: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Of up to ROWS rows at a time the ids and the local scores (queries x rows) of each list."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column("id").to_numpy(), [vectors.products(q, vectors.matrix(part.column(f"l{i}"), w)) for i, (q, w) in enumerate(zip(lists, widths, strict=True))]


def _heads(local: list[np.ndarray], own: np.ndarray, k: int) -> np.ndarray:
    """The k best whole scores among the heads of the local lists, NONE where there are fewer. A head is of k + 1, since one may be the query's own row."""
    rows = local[0].shape[1]
    n = min(k + 1, rows)
    at = np.sort(np.concatenate([np.argpartition(s, rows - n, axis=1)[:, rows - n :] for s in local], axis=1), axis=1)
    score = sum(np.take_along_axis(s, at, axis=1) for s in local)
    again = np.zeros(at.shape, bool)
    again[:, 1:] = at[:, 1:] == at[:, :-1]
    return _largest(np.where(again | np.take_along_axis(own, at, axis=1), NONE, score), k)


def _largest(scores: np.ndarray, k: int) -> np.ndarray:
    if scores.shape[1] < k:
        scores = np.pad(scores, ((0, 0), (0, k - scores.shape[1])), constant_values=NONE)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k :]


def _best(entries: list[np.ndarray], k: int) -> np.ndarray:
    """The k best of each query of (query, score, id) columns, by score, then id."""
    e = np.concatenate(entries, axis=1)
    e = e[:, np.lexsort((e[2], -e[1], e[0]))]
    first = np.searchsorted(e[0], e[0])
    return e[:, np.arange(e.shape[1]) - first < k]


def _floors(table: DataFrame, ids: np.ndarray, lists: list[np.ndarray], widths: list[int], k: int) -> np.ndarray:
    """Phase 1: under each query's k-th score a floor, NONE if the heads hold fewer rows."""
    n = len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full((n, k), NONE, np.int64)
        for these, local in _slices(batches, widths, lists):
            top = _largest(np.concatenate([top, _heads(local, ids[:, None] == these[None, :], k)], axis=1), k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array(list(top), pa.list_(pa.int64()))], ["i", "top"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, top in zip(batch.column("i").to_pylist(), vectors.matrix(batch.column("top"), k), strict=True):
                held[i] = _largest(np.concatenate([held[i], top])[None, :], k)[0] if i in held else top
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([int(t.min()) for t in held.values()], pa.int64())], ["i", "low"])

    rows = table.mapInArrow(run, "i int, top array<long>").repartition("i").mapInArrow(merge, "i int, low long").collect()  # a row per query of the block
    floors = np.full(n, NONE, np.int64)
    for r in rows:
        floors[r["i"]] = r["low"]
    return floors


def _collected(table: DataFrame, ids: np.ndarray, lists: list[np.ndarray], widths: list[int], floors: np.ndarray, k: int) -> DataFrame:
    """Phases 2 and 3: (query_id, score, id) of all rows that may be among the best."""
    cutoff = np.where(floors == NONE, np.iinfo(np.int64).min, -(-floors // len(widths)))  # rounded up: local scores are integers
    limit = max(HELD, 2 * len(ids) * k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, held = [np.zeros((3, 0), np.int64)], 0
        for these, local in _slices(batches, widths, lists):
            some = local[0] >= cutoff[:, None]
            for s in local[1:]:
                some |= s >= cutoff[:, None]
            q, r = np.nonzero(some)
            score = sum(s[q, r] for s in local)
            on = (score >= floors[q]) & (these[r] != ids[q])
            entries.append(np.array([q[on], score[on], these[r[on]]]))
            held += entries[-1].shape[1]
            if held > limit:
                entries = [_best(entries, k)]
                held = entries[0].shape[1]
        e = _best(entries, k)
        yield pa.RecordBatch.from_arrays([pa.array(ids[e[0]], pa.int64()), pa.array(e[1], pa.int64()), pa.array(e[2], pa.int64())], ["query_id", "score", "id"])

    return table.mapInArrow(run, "query_id long, score long, id long")


def top_k(rows: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, lists: int = 2, block: int = BLOCK, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the ``k`` rows with the largest integer inner product with each query, ties to smaller ids.

    Components become floor(scale * x), held within +-2**27 for 64 dimensions, so that scores fit 64 bits. Vectors that are null or
    hold a null or a number that isn't finite take no part; a shorter one counts as followed by zeros. Rows with the query's id are its
    own and no candidates; of several query rows with one id the smallest vector asks. A null id is no query and comes last
    among equal scores (as does 2**63 - 1, which it stands for). A query has fewer rows if there are fewer candidates; an empty table gives none.
    """
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector).alias("v")).filter(vectors.usable(F.col("v")))
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], schema)
    parts = [p for p in np.array_split(np.arange(width), lists) if len(p)] or [np.zeros(0, int)]
    widths = [len(p) for p in parts]
    padded = F.concat(vectors.quantised(F.col("v"), scale, vectors.bound(width, 60)), F.array_repeat(F.lit(0), F.lit(width) - F.size("v")))
    columns = [F.slice(F.col("q"), int(p[0]) + 1 if len(p) else 1, len(p)).alias(f"l{i}") for i, p in enumerate(parts)]
    table = store.written(rows.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), (F.col("asks") & F.col("id").isNotNull()).alias("asks"), padded.alias("q")).select("id", "asks", *columns), "vectors")
    asking = table.filter("asks").groupBy("id").agg(F.min(F.struct(*[f"l{i}" for i in range(len(parts))])).alias("q"))
    asking = store.written(asking.select("id", "q.*"), "queries")
    path, last, done = store.new_path(spark, "top-k"), None, 0
    while True:
        some = (asking if last is None else asking.filter(F.col("id") > last)).orderBy("id").limit(block).collect()  # at most ``block`` queries
        if not some:
            break
        last = some[-1]["id"]
        ids = np.array([r["id"] for r in some], np.int64)
        local = [np.array([r[f"l{i}"] for r in some], np.int64).reshape(len(some), w) for i, w in enumerate(widths)]
        floors = _floors(table, ids, local, widths, k)
        found = _collected(table, ids, local, widths, floors, k)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
        best = found.withColumn("rank", place).filter(F.col("rank") <= k)
        best.select("query_id", "rank", F.nullif("id", F.lit(NO_ID)).alias("vec_id"), "score").write.mode("append").parquet(path)
        done += 1
        store.release()
    return spark.read.schema(schema).parquet(path) if done else spark.createDataFrame([], schema)
