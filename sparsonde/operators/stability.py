"""Stability selection: thresholds, intersections of supports over resamples, and their union over classes."""

from __future__ import annotations

from collections.abc import Sequence
from numbers import Integral, Real

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def thresholds(stability_selection: float | int | Sequence, boots: int) -> list[int]:
    """Counts of boots in which a feature must be selected: floats are shares (rounded down), integers counts; all of one kind, within 1 .. boots."""
    many = list(stability_selection) if isinstance(stability_selection, list | tuple | np.ndarray) else [stability_selection]
    if not many:
        raise ValueError("stability_selection is empty")
    if any(isinstance(x, bool | np.bool_) for x in many):
        raise ValueError("stability_selection must hold numbers")
    if all(isinstance(x, Integral) for x in many):
        out = [int(x) for x in many]
    elif all(isinstance(x, Real) and not isinstance(x, Integral) for x in many):
        out = [int(x * boots) for x in many]
    else:
        raise ValueError("stability_selection must be all integers or all floats")
    if any(not 1 <= x <= boots for x in out):
        raise ValueError(f"stability_selection must lie within 1 and {boots} boots: {out}")
    return out


def threshold(stability_selection: float | int, boots: int) -> int:
    """As thresholds(), of a single number."""
    if isinstance(stability_selection, list | tuple | np.ndarray):
        raise ValueError("stability_selection must be one number")
    return thresholds(stability_selection, boots)[0]


def selection_counts(coefs: DataFrame) -> DataFrame:
    """(reg_idx, feature, times): in how many boots each feature has a nonzero coefficient. ``coefs``: boot, reg_idx, feature, coef."""
    return coefs.groupBy("reg_idx", "feature").agg(F.count_if(F.col("coef") != 0).alias("times"))


def intersections(coefs: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(support_id, support): the distinct supports over all (threshold, setting) pairs; ``support`` holds a boolean per feature, in order; ids follow the arrays' order."""
    limit = F.explode(F.array(*[F.lit(int(x)) for x in limits])).alias("limit")
    counts = selection_counts(coefs).select("*", limit)
    flags = counts.groupBy("limit", "reg_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", (F.col("times") >= F.col("limit")).alias("on")))), lambda s: s["on"]).alias("support"))
    return numbered(flags.select("support").distinct())


def shared(supports: DataFrame, classes: int) -> DataFrame:
    """Supports over classes * features (class by class) made supports over features: a feature is in if it is in for any class."""
    p = (F.size("support") / classes).cast("int")
    any_class = F.transform(F.sequence(F.lit(0), p - 1), lambda j: F.exists(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.element_at("support", (k * p + j + 1).cast("int"))))
    return numbered(supports.select(any_class.alias("support")).distinct())


def numbered(supports: DataFrame) -> DataFrame:
    """There are at most settings * thresholds supports, so one window orders them."""
    order = F.transform("support", lambda x: x.cast("int"))
    return supports.withColumn("support_id", (F.row_number().over(Window.orderBy(order)) - 1).cast("int")).select("support_id", "support")


def best_supports(scores: DataFrame) -> DataFrame:
    """The row of each boot with the largest score; of equal ones that with the smallest support_id."""
    first = F.row_number().over(Window.partitionBy("boot").orderBy(F.col("score").desc(), "support_id"))
    return scores.withColumn("first_", first).filter("first_ = 1").drop("first_")


def median_union(best: DataFrame) -> DataFrame:
    """(feature, coef): the median over boots of each coefficient of the best supports' estimates (column ``coefs``)."""
    return best.select(F.posexplode("coefs").alias("feature", "coef")).groupBy("feature").agg(F.median("coef").alias("coef"))
