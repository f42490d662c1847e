"""Density clusters of one numeric column, on rows that stay distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A block of a running maximum has at most 2 ** BITS keys.
BITS = 10
#: Keys with over a 1 / SHARE part of the rows, so fewer than SHARE keys, are looked up by broadcast.
SHARE = 1000


def dbscan(df: DataFrame, id_col: str, value_col: str, eps: float, min_samples: int = 1) -> DataFrame:
    """``df``'s ids with ``cluster``: the smallest id of a cluster's core rows, or -1 for noise.

    A row is core if ``min_samples`` rows, itself included, lie within ``eps`` of it; core rows within ``eps`` of each other are of one cluster, and other
    rows go to the smallest cluster within ``eps``. Values that are null, not finite or beyond 2^62 ``eps`` are noise. Rows fall into cells as wide as
    ``eps``: those of a cell are all neighbours, so a cell of ``min_samples`` rows is core as a whole, and the others hold fewer rows than that. Cells know
    their neighbours by their ``min_samples`` outermost values only; no pairs of rows are made.
    """
    if eps <= 0 or min_samples < 1:
        raise ValueError("eps must be positive and min_samples at least 1")
    rows = df.select(F.col(id_col).alias("id"), F.col(value_col).cast("double").alias("x"))
    rows = rows.withColumn("cell", F.when(F.abs("x") < eps * 2.0**62, F.floor(F.col("x") / eps)))
    bounds = rows.agg(F.min("cell").alias("low"), F.max("cell").alias("high")).first()
    if bounds["low"] is None:
        return rows.select(F.col("id").alias(id_col), F.lit(-1).cast("long").alias("cluster"))
    cells = _cut(_cells(rows.filter("cell IS NOT NULL"), eps, min_samples))
    live = cells.filter("core_low IS NOT NULL").select("cell", "core_low", "core_high", "first")
    table = _cut(_with_neighbours(cells.select("cell", "n", "core"), _cut(_labelled(live, eps, bounds["low"], bounds["high"]))))
    met = _looked_up(rows, table, "cell")
    is_core = (F.col("n") >= min_samples) | F.array_contains("core", F.struct("x", "id"))
    border = F.least("label", F.when(F.col("x") - F.col("before_high") <= eps, F.col("before")), F.when(F.col("after_low") - F.col("x") <= eps, F.col("after")))
    return met.select(F.col("id").alias(id_col), F.coalesce(F.when(is_core, F.col("label")).otherwise(border), F.lit(-1)).cast("long").alias("cluster"))


def _cut(df: DataFrame) -> DataFrame:
    """The rows with their lineage cut, in the session's checkpoint folder; kept by the executors where none is set."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def _cells(rows: DataFrame, eps: float, k: int) -> DataFrame:
    """A row per cell: ``n``, its core rows if it has fewer than ``k`` rows, the range of its core values and the smallest core id."""

    def outermost(order: Column) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy(order, "id"))).filter(F.col("rank") <= k)

    size = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.min("x").alias("low"), F.max("x").alias("high"))
    lows = outermost(F.asc("x")).groupBy("cell").agg(F.collect_list(F.struct("x", "id")).alias("lows"))
    highs = outermost(F.desc("x")).groupBy("cell").agg(F.collect_list("x").alias("highs"))
    ends = size.join(lows, "cell").join(highs, "cell")
    left = ends.select((F.col("cell") + 1).alias("cell"), F.col("highs").alias("left"))
    right = ends.select((F.col("cell") - 1).alias("cell"), F.col("lows.x").alias("right"))
    none = F.array().cast("array<double>")

    def around(x: Column) -> Column:
        below = F.size(F.filter(F.coalesce("left", none), lambda v: x - v <= eps))
        return F.col("n") + below + F.size(F.filter(F.coalesce("right", none), lambda v: v - x <= eps))

    near = ends.join(left, "cell", "left").join(right, "cell", "left")
    near = near.withColumn("core", F.when(F.col("n") < k, F.filter("lows", lambda p: around(p["x"]) >= k)))
    dense = F.col("n") >= k
    return near.select(
        "cell",
        "n",
        "core",
        F.when(dense, F.col("low")).otherwise(F.array_min("core.x")).alias("core_low"),
        F.when(dense, F.col("high")).otherwise(F.array_max("core.x")).alias("core_high"),
        F.when(dense, F.col("first")).otherwise(F.array_min("core.id")).alias("first"),
    )


def _labelled(live: DataFrame, eps: float, low: int, high: int) -> DataFrame:
    """Adds ``label``, the smallest core id of a cell's run: cells whose core values lie within ``eps`` of the cell before belong to its run."""
    before = live.select((F.col("cell") + 1).alias("cell"), F.col("core_high").alias("met"))
    starts = F.when(F.col("met").isNull() | (F.col("core_low") - F.col("met") > eps), F.col("key"))
    marked = live.join(before, "cell", "left").withColumn("key", F.col("cell") - F.lit(low)).withColumn("value", starts)
    runs = _cut(_before(_cut(marked), (high - low).bit_length()).withColumn("run", F.greatest("value", "before")).drop("before", "value", "key", "met"))
    return _looked_up(runs, runs.groupBy("run").agg(F.min("first").alias("label")), "run")


def _before(df: DataFrame, bits: int) -> DataFrame:
    """Adds ``before``, the largest ``value`` at smaller keys (0 .. 2^bits, each once): windows of 2^BITS keys, whose maxima do the same a level up."""
    window = Window.partitionBy("block").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn("block", F.shiftright("key", BITS)).withColumn("before", F.max("value").over(window))
    if bits <= BITS:
        return inside.drop("block")
    above = _before(inside.groupBy(F.col("block").alias("key")).agg(F.max("value").alias("value")), bits - BITS)
    carried = inside.join(above.select(F.col("key").alias("block"), F.col("before").alias("carry")), "block")
    return carried.withColumn("before", F.greatest("before", "carry")).drop("block", "carry")


def _with_neighbours(cells: DataFrame, labelled: DataFrame) -> DataFrame:
    own = labelled.select("cell", "label")
    left = labelled.select((F.col("cell") + 1).alias("cell"), F.col("core_high").alias("before_high"), F.col("label").alias("before"))
    right = labelled.select((F.col("cell") - 1).alias("cell"), F.col("core_low").alias("after_low"), F.col("label").alias("after"))
    return cells.join(own, "cell", "left").join(left, "cell", "left").join(right, "cell", "left")


def _looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join with a table of one row per key that doesn't send frequent keys' rows to one task."""
    hot = rows.groupBy(key).agg(F.count("*").alias("rows__")).filter(F.col("rows__") * SHARE > rows.count()).filter(F.col(key).isNotNull()).select(key)
    often = rows.join(F.broadcast(table.join(F.broadcast(hot), key)), key)
    return often.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key, "left"))
