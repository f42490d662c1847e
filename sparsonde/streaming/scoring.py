"""Fitted models on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scored(stream: DataFrame, model, **more) -> DataFrame:
    """A model's predictions on a streaming table: a stateless projection, so it needs no watermark and any output mode works."""
    return model.transform(stream, **more)


def windowed_moments(stream: DataFrame, time: str, x: str, y: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts, sums and products of (x, y) per window: what a least-squares fit per window needs. Late rows count until the watermark passes."""
    by = stream.withWatermark(time, late).groupBy(F.window(time, every))
    return by.agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
