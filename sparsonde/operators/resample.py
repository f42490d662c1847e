"""Resampling by a portable integer hash: the same rows are drawn whatever the partitioning, in Spark SQL, numpy and other engines."""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

M = 2147483647


def hash_sql(row: str, boot: str, seed: int) -> str:
    """SQL for the hash of (row, boot): a number below M. Row ids must be from 0 to M - 1."""
    one = f"(({row} * 48271 + {boot} * 69621 + {seed} * 16807 + 1) % {M})"
    two = f"(({one} * {one} + {boot} * 40692 + 12345) % {M})"
    three = f"(({two} * {two} + {row}) % {M})"
    return f"(({three} * {three} + {boot} + {seed}) % {M})"


def hash_column(row: Column, boot: Column, seed: int) -> Column:
    """The hash as a column expression."""
    m = F.lit(M).cast("long")
    row, boot = row.cast("long"), boot.cast("long")
    x = (row * F.lit(48271).cast("long") + boot * F.lit(69621).cast("long") + F.lit(seed * 16807 + 1).cast("long")) % m
    x = (x * x + boot * F.lit(40692).cast("long") + F.lit(12345).cast("long")) % m
    x = (x * x + row) % m
    return (x * x + boot + F.lit(seed).cast("long")) % m


def hash_array(row: np.ndarray, boot: int | np.ndarray, seed: int) -> np.ndarray:
    row = row.astype(np.int64)
    x = (row * 48271 + boot * 69621 + seed * 16807 + 1) % M
    x = (x * x + boot * 40692 + 12345) % M
    x = (x * x + row) % M
    return (x * x + boot + seed) % M


#: Ranges of a hash in which rows are numbered.
ID_BITS = 14


def seed_of(random_state: int | None) -> int:
    """An integer seed; None draws one, once, on the driver."""
    return random.randrange(1, 100_000) if random_state is None else int(random_state) % 100_000


def with_row_id(df: DataFrame, keys: Sequence[str], name: str = "row_id") -> DataFrame:
    """Numbers rows from 0 in the order of a hash of ``keys``, so that content alone decides: rows are counted in 2**ID_BITS ranges of the hash and ranked within them, never all in one task."""
    h = F.xxhash64(*keys)
    binned = df.withColumn("hash__", h).withColumn("bin__", F.shiftrightunsigned("hash__", 64 - ID_BITS))
    ahead = Window.orderBy("bin__").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    first = binned.groupBy("bin__").agg(F.count("*").alias("n__")).select("bin__", F.coalesce(F.sum("n__").over(ahead), F.lit(0)).alias("first__"))
    rank = F.row_number().over(Window.partitionBy("bin__").orderBy("hash__", *keys)) - 1
    return binned.join(F.broadcast(first), "bin__").select(*df.columns, (F.col("first__") + rank).cast("long").alias(name))


def test_size(n: int, fraction: float) -> int:
    """Rows left out of a training share ``fraction`` of ``n``."""
    return int(np.ceil((1 - fraction) * n - 1e-9))


def cutoffs(df: DataFrame, id_col: str, boots: int, fraction: float, seed: int, stratum: str | None = None) -> DataFrame:
    """(boot[, stratum], cut_h, cut_id): the last (hash, id) of each boot's test rows, so that sizes are exact.

    No sort of the rows: hashes are counted in 4096 bins per boot first, and only the bin that holds the cut is looked at row by row. Those bins
    are broadcast, one per boot and stratum, so of the rows only what lies in them moves.
    """
    by = ["boot"] + (["stratum"] if stratum else [])
    rows = df.select(F.col(id_col).cast("long").alias("id"), *([F.col(stratum).alias("stratum")] if stratum else []))
    rows = rows.withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(boots - 1)))).withColumn("h", hash_column(F.col("id"), F.col("boot"), seed))
    width = M // 4096 + 1
    rows = rows.withColumn("bin", F.floor(F.col("h") / width).cast("int"))
    bins = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*by)
    total = F.sum("n").over(whole)
    bins = bins.withColumn("test", F.ceil((1 - F.lit(fraction)) * total - 1e-9)).withColumn("upto", F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    edge = bins.filter((F.col("upto") >= F.col("test")) & (F.col("upto") - F.col("n") < F.col("test"))).select(*by, "bin", (F.col("test") - F.col("upto") + F.col("n")).alias("more"))
    inside = rows.join(F.broadcast(edge), [*by, "bin"]).withColumn("rank", F.row_number().over(whole.orderBy("h", "id")))
    return inside.filter(F.col("rank") == F.col("more")).select(*by, F.col("h").alias("cut_h"), F.col("id").alias("cut_id"))


def split(df: DataFrame, id_col: str, boots: int, fraction: float, seed: int, stratum: str | None = None) -> DataFrame:
    """``df`` for each boot with ``boot`` and ``is_train``; exact sizes, proportional within ``stratum`` if given."""
    by = ["boot"] + (["stratum"] if stratum else [])
    cut = cutoffs(df, id_col, boots, fraction, seed, stratum)
    rows = df.withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(boots - 1))))
    if stratum:
        cut = cut.withColumnRenamed("stratum", "stratum_")
        rows = rows.join(cut, (rows["boot"] == cut["boot"]) & rows[stratum].eqNullSafe(cut["stratum_"]), "left").drop(cut["boot"], "stratum_")
    else:
        rows = rows.join(cut, by, "left")
    h = hash_column(F.col(id_col), F.col("boot"), seed)
    test = F.col("cut_h").isNotNull() & ((h < F.col("cut_h")) | ((h == F.col("cut_h")) & (F.col(id_col) <= F.col("cut_id"))))
    return rows.withColumn("is_train", ~F.coalesce(test, F.lit(False))).drop("cut_h", "cut_id")


def multiplicities(df: DataFrame, id_col: str, boots: int, seed: int, n: int | None = None) -> DataFrame:
    """(boot, row_id, times): a bootstrap with replacement as counts; ids must be 0 .. n - 1."""
    n = df.count() if n is None else n
    draws = df.select(F.col(id_col).cast("long").alias("draw")).withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(boots - 1))))
    return draws.select("boot", (hash_column(F.col("draw"), F.col("boot"), seed) % n).alias("row_id")).groupBy("boot", "row_id").agg(F.count("*").alias("times"))
