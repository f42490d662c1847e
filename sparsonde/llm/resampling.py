"""Importance resampling towards a target distribution, by a dictionary of distinct features.

A feature is a run of words. Tasks count the distinct feature strings of their texts, Spark adds the counts up to a dictionary
(a row per string, with its count in the corpus and in the target), each string of it is hashed once, buckets are summed and
every entry gets its bucket's gain. The gains then meet the documents' own feature counts: the frequent entries (those
with more than one in ``HOT`` of all features, so fewer than HOT, and of at most HOT times a feature's mean length together) are
broadcast, and tasks add them up where the text is; the other features of a document go through a join by string, in which no key is
frequent. Documents are drawn by the largest Gumbel-perturbed weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .textblock import blocks

HOT = 1 << 17
#: Bytes of text of which a task holds the features at once (a longer text alone).
AT_ONCE = 4 << 20
#: Of each byte whether it stands between words: ASCII but digits and lower-case letters (upper-case ones have been lowered).
BETWEEN = np.array([b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) for b in range(256)])


def _features(texts: pa.Array, lengths: tuple[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Of each block of texts its first row, the number of words of each, and of every feature its row, its place in the block's dictionary, and that dictionary."""
    for w in blocks(texts, lower=True, limit=AT_ONCE, between=BETWEEN):
        size = w.end - w.start
        ends = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        one = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(w.data[~BETWEEN[w.data]])))
        docs, runs, now = [], [], one
        for n in range(1, lengths[1] + 1):
            if n > 1:
                if not len(now):
                    break
                now = pc.binary_join_element_wise(now[:-1], one[n - 1 :], pa.scalar(" ", pa.large_string()))
            if n >= lengths[0]:
                inside = w.doc[: len(now)] == w.doc[n - 1 : n - 1 + len(now)]
                docs.append(w.doc[: len(now)][inside])
                runs.append(now.filter(pa.array(inside)))
        found = (pa.chunked_array(runs).combine_chunks() if len(runs) > 1 else runs[0] if runs else one[:0]).dictionary_encode()
        yield w.first, w.counts(), np.concatenate(docs) if docs else np.zeros(0, np.int64), found.indices.to_numpy(), found.dictionary


def _dictionary(texts: DataFrame, text: str, lengths: tuple[int, int]) -> DataFrame:
    """(feature, n): the distinct features of all texts and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, place, names in _features(batch.column("t"), lengths):
                yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(np.bincount(place, minlength=len(names)), pa.int64())], ["feature", "n"])

    return texts.select(F.col(text).alias("t")).mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def gains(dictionary: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain): floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, from ``dictionary`` (bucket, s, t)."""
    sums = dictionary.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    all_s, all_t = (x or 0 for x in sums.agg(F.sum("s"), F.sum("t")).first())
    more = lambda c: F.col(c).cast("double") + 1.0
    return sums.select("bucket", F.floor(F.ln(more("t") * float(all_s + buckets) / (more("s") * float(all_t + buckets))) * 1000).alias("gain"))


def _measured(docs: DataFrame, hot: dict[str, int], lengths: tuple[int, int], row: Column) -> DataFrame:
    """Of each document a number of its own, ``row``, n_words, n_features, the sum of its frequent features' gains, and its other features with their counts."""
    kind = docs.select(row.alias("d")).schema["d"].dataType
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((list(hot), list(hot.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_of, gain_of = shared.value
        known, worth = pa.array(names_of, pa.large_string()), np.array([*gain_of, 0], np.int64)
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, n_words, doc, place, names in _features(batch.column("t"), lengths):
                rows = len(n_words)
                at = pc.fill_null(pc.index_in(names, value_set=known), len(names_of)).to_numpy().astype(np.int64) if len(names) else np.zeros(0, np.int64)
                of = at[place]
                sums = np.bincount(doc, worth[of], rows).astype(np.int64)  # doubles hold these sums
                rare = of == len(names_of)
                key, times = np.unique(doc[rare] * max(len(names), 1) + place[rare], return_counts=True)
                cuts = np.searchsorted(key, np.arange(rows + 1) * max(len(names), 1)).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(cuts), names.take(pa.array(key % max(len(names), 1))).cast(pa.string()))
                counted = pa.ListArray.from_arrays(pa.array(cuts), pa.array(times, pa.int64()))
                part = batch.column("d").slice(first, rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + rows)), part, pa.array(n_words, pa.int64()), pa.array(np.bincount(doc, minlength=rows), pa.int64()), pa.array(sums), listed, counted], ["rid", "d", "n_words", "n_features", "sum", "rare", "times"])
                rid += rows

    schema = f"rid long, d {kind.simpleString()}, n_words long, n_features long, sum long, rare array<string>, times array<long>"
    return docs.select(row.alias("d"), F.col("text").alias("t")).mapInArrow(run, schema)


def gumbel(id_: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the first 32 bits of sha256 of ``seed:id``; a null id counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.ln(-F.ln((h + 0.5) / 4294967296.0)) * -1000)


def ranked(scores: DataFrame, may: Column, share: int) -> DataFrame:
    """Adds ``rank`` (1, 2 ... by score, ties to smaller ``d``) of the floor(share * N / 100) best of the N rows that ``may`` be drawn; null for others.

    Rows are counted by score first (scores are integers of a bounded range), so only rows of one score are ever sorted together.
    """
    rows = scores.withColumn("may", may)
    counts = rows.filter("may").groupBy("score").agg(F.count("*").alias("n"))
    ahead = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    steps = counts.select(F.col("score").alias("score_"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy()).alias("all"))
    steps = steps.withColumn("draw", F.floor(F.col("all") * share / 100)).filter(F.col("ahead") < F.col("draw"))
    steps = store.written(steps, "score-steps")
    at = rows.join(F.broadcast(steps), F.col("may") & (F.col("score") == F.col("score_")), "left")
    order = Window.partitionBy("score").orderBy(F.col("d").asc_nulls_last(), "n_features", "weight", "rid")
    top = at.filter(F.col("ahead").isNotNull())
    top = top.withColumn("rank", F.col("ahead") + F.row_number().over(order)).withColumn("rank", F.when(F.col("rank") <= F.col("draw"), F.col("rank")))
    rest = at.filter(F.col("ahead").isNull()).withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(rest).drop("may", "score_", "ahead", "all", "draw")


def resample(docs: DataFrame, target: DataFrame, lengths: tuple[int, int] = (1, 1), buckets: int = 10000, share: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs`` (doc_id, text), drawn towards the texts of ``target`` (text).

    Words are runs of digits, letters and characters beyond ASCII, A-Z lowered; features are all runs of ``lengths`` words. A null
    or empty text has none: weight 0, never drawn (fewer than ``least_words`` words). Rows that share a doc_id are documents of their own with the same
    random number; of equal scores the smaller doc_id goes first, null last. Empty ``docs`` give no rows; of an empty target all weights follow from its counts, 0.
    """
    s, t = _dictionary(docs, "text", lengths), _dictionary(target, "text", lengths)
    found = s.select("feature", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(t.select("feature", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    found = found.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).withColumn("bucket", (F.crc32(F.col("feature").cast("binary")) % buckets).cast("int"))
    dictionary = store.written(found, "features")
    worth = store.written(gains(dictionary, buckets), "gains")
    entries = dictionary.filter("s > 0").join(F.broadcast(worth), "bucket").select("feature", "s", "gain")
    total = dictionary.agg(F.sum("s")).first()[0] or 0
    hot = {r["feature"]: r["gain"] for r in entries.filter(F.col("s") > total / HOT).select("feature", "gain").collect()}  # fewer than HOT
    rows = store.written(_measured(docs, hot, lengths, F.col("doc_id")), "document-features")
    pairs = rows.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("feature"), F.col("x.times").alias("times"))
    rare = pairs.join(entries.filter(F.col("s") <= total / HOT), "feature").groupBy("rid").agg(F.sum(F.col("times") * F.col("gain")).alias("more"))
    rows = rows.select("rid", "d", "n_words", "n_features", "sum").join(rare, "rid", "left").withColumn("sum", F.col("sum") + F.coalesce("more", F.lit(0)))
    n = F.greatest("n_features", F.lit(1))
    rows = rows.withColumn("weight", ((F.col("sum") - F.pmod("sum", n)) / n).cast("long"))
    scores = store.written(rows.select("rid", "d", "n_words", "n_features", "weight", (F.col("weight") + gumbel(F.col("d"), seed)).alias("score")), "scores")
    return ranked(scores, F.col("n_words") >= least_words, share).select(F.col("d").alias("doc_id"), "n_words", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, **more) -> DataFrame:
    """The documents drawn, with their rank: ``docs`` must have one row per doc_id."""
    chosen = resample(docs, target, **more).filter("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_"), F.col("rank"))
    return docs.join(chosen, F.col("doc_id") == F.col("drawn_")).drop("drawn_")
