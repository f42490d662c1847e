"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Each source gets a target in words; its complete epochs are taken first, and the rest of the target is
filled with documents in the order of their exponential keys ``-ln(u) / quality``. The prefix sum that
finds where the rest ends never sorts a source in one task: keys fall into equally likely buckets (the
keys' distribution is known exactly), buckets are summed, and only the one bucket per source that holds
the end is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: The quality classes: a document's weight in the draw.
QUALITY = (1.0, 0.5, 0.25, 0.125)
BUCKETS = 4096


def quality_class(text: Column, size: Column) -> Column:
    """Index in QUALITY by symbols per word: under 1/50, under 1/10, under 1/2, more."""
    n = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(n * 50 < size, 0).when(n * 10 < size, 1).when(n * 2 < size, 2).otherwise(3)


def _draw(id_: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), id_, text)


def _class(quality: Column | None, text: Column, size: Column) -> Column:
    return quality_class(text, size) if quality is None else F.least(F.greatest(F.coalesce(quality.cast("int"), F.lit(len(QUALITY) - 1)), F.lit(0)), F.lit(len(QUALITY) - 1))


def _measured(docs: DataFrame, seed: int, quality: Column | None = None) -> DataFrame:
    """doc_id, source, size, quality class ``q`` and the draw's 64 bits ``h`` of every row."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), F.coalesce("text", F.lit("")).alias("t"), (F.lit(0) if quality is None else quality).alias("q"))
    return rows.select("doc_id", "source", "size", _class(None if quality is None else F.col("q"), F.col("t"), F.col("size")).alias("q"), _draw(F.col("doc_id"), F.col("t"), seed).alias("h"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the exponential key ``e`` of each row."""
    u = (F.shiftrightunsigned("h", 11).cast("double") + 0.5) / float(1 << 53)
    w = F.element_at(F.array(*[F.lit(x) for x in QUALITY]), F.col("q") + 1)
    return rows.withColumn("e", -F.ln(u) / w)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``target`` of each row of ``sizes`` (source, source_size): ``share`` of all words dealt by weight, no source above
    ``cap`` times its size, the excess dealt again by weight. A row per source goes through the one ordered window."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    all_rows = Window.partitionBy()
    rows = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * cap).withColumn("level", F.col("most") / F.col("w"))
    rows = rows.withColumn("total", F.sum("source_size").over(all_rows) * share).withColumn("all_w", F.sum("w").over(all_rows))
    before = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    full, spent = F.coalesce(F.sum("most").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("capped", F.col("level") <= (F.col("total") - full) / (F.col("all_w") - spent))
    left = F.col("total") - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0)).over(all_rows)
    free = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(all_rows)
    rows = rows.withColumn("left", left).withColumn("free", free)
    target = F.when(F.col("capped"), F.col("most")).otherwise(F.col("left") * F.col("w") / F.nullif("free", F.lit(0.0)))
    return rows.select(*sizes.columns, target.alias("target"))


def _ends(rows: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """A row per source: source_size, target, epochs, and the last key (``end_e``, ``end_id``, ``end_h``) of the fractional part."""
    classes = [F.count(F.when(F.col("q") == i, 1)).alias(f"n{i}") for i in range(len(QUALITY))]
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), *classes)
    plan = targets(sizes, weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    plan = plan.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    plan = store.written(plan, "mix-plan")
    #: The keys' distribution in a source is this mixture of exponentials, so buckets of equal probability get equal shares.
    below = sum((F.col(f"n{i}") / F.col("n") * (1 - F.exp(-F.lit(w) * F.col("e"))) for i, w in enumerate(QUALITY)), F.lit(0.0))
    bucket = F.least(F.floor(below * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    one = plan.select(F.col("source").alias("s_"), "rest", "n", *[f"n{i}" for i in range(len(QUALITY))])
    dealt = _keyed(rows).join(one, F.col("source").eqNullSafe(F.col("s_"))).filter("rest > 0").withColumn("bucket", bucket)
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("in_bucket")).withColumn("upto", F.sum("in_bucket").over(up_to))
    last = sums.filter((F.col("upto") - F.col("in_bucket") < F.col("rest")) & (F.col("upto") >= F.col("rest")))
    last = last.groupBy(F.col("source").alias("ls_")).agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("in_bucket")).alias("before")), "bucket").alias("last"))
    last = last.select("ls_", F.col("last.bucket").alias("lb_"), F.col("last.before").alias("before"))
    edge = dealt.join(last, F.col("source").eqNullSafe(F.col("ls_")) & (F.col("bucket") == F.col("lb_")))
    in_order = Window.partitionBy("source").orderBy("e", "doc_id", "h").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.sum("size").over(in_order) + F.col("before")).filter(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    chosen = edge.groupBy("source").agg(F.max(F.struct("e", "doc_id", "h")).alias("end"))
    lows = last.join(chosen.withColumnRenamed("source", "cs_"), F.col("ls_").eqNullSafe(F.col("cs_")), "left").select("ls_", "lb_", "end")
    ends = plan.select("source", "source_size", "target", "epochs", "rest", "n", *[f"n{i}" for i in range(len(QUALITY))])
    ends = ends.join(lows, F.col("source").eqNullSafe(F.col("ls_")), "left").drop("ls_")
    return store.written(ends, "mix-ends")


def _taken(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Joins ``rows`` (with q, h, size) to their source's end; adds ``copies``."""
    below = sum((F.col(f"n{i}") / F.col("n") * (1 - F.exp(-F.lit(w) * F.col("e"))) for i, w in enumerate(QUALITY)), F.lit(0.0))
    bucket = F.least(F.floor(below * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    got = _keyed(rows).join(ends.withColumnRenamed("source", "s_"), F.col("source").eqNullSafe(F.col("s_")))
    drawn = (F.col("rest") > 0) & (F.col("lb_").isNull() | (bucket < F.col("lb_")) | ((bucket == F.col("lb_")) & F.coalesce(F.struct("e", "doc_id", "h") <= F.col("end"), F.lit(False))))
    return got.withColumn("copies", F.col("epochs") + drawn.cast("long"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, quality: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies times size) of every row of ``docs``.

    Sources in code point order, null last, get ``weights`` in turn. A null text has size 0 and is taken or not like any other.
    ``quality``: the index in QUALITY of each row's weight (a model's verdict, say; null counts as the last); by default that
    of its symbols per word. Rows alike in doc_id, source and text share one draw. Sources without words have target 0; an empty table gives none.
    """
    rows = store.written(_measured(docs, seed, quality), "mix-rows")
    got = _taken(rows, _ends(rows, weights, share, cap))
    return got.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, quality: Column | None = None) -> DataFrame:
    """The mixture itself: ``docs`` with each row as often as it is taken, its columns unchanged; parameters as for mix_plan."""
    cols = docs.columns
    rows = store.written(_measured(docs, seed, quality), "mix-rows")
    ends = _ends(rows, weights, share, cap)
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    full = docs.select("doc_id", "source", F.struct(*[docs[c] for c in cols]).alias("row"), F.coalesce("text", F.lit("")).alias("t"), size.alias("size"), (F.lit(0) if quality is None else quality).alias("q"))
    full = full.select("doc_id", "source", "row", _class(None if quality is None else F.col("q"), F.col("t"), F.col("size")).alias("q"), _draw(F.col("doc_id"), F.col("t"), seed).alias("h"))
    got = _taken(full, ends).filter("copies > 0")
    return got.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
