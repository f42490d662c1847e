"""Reading design matrices and keeping fitted tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def load_xy(spark: SparkSession, path: str, features: Sequence[str], label: str, id_col: str | None = None, format: str = "parquet", **options) -> DataFrame:
    """The feature, label and id columns of a stored table; the scan reads only those."""
    return spark.read.format(format).options(**options).load(path).select(*([id_col] if id_col else []), *features, label)


def save_tables(tables: dict[str, DataFrame], path: str, format: str = "parquet") -> None:
    """Each table below ``path``, replacing what is there."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(format).save(f"{path}/{name}")


def vector_columns(df: DataFrame, column: str, prefix: str, size: int) -> DataFrame:
    """An array column's entries as columns prefix0 .. of doubles."""
    return df.select(*[c for c in df.columns if c != column], *[df[column][j].cast("double").alias(f"{prefix}{j}") for j in range(size)])


def sparse_to_wide(df: DataFrame, row: str, feature: str, value: str, features: Sequence[int], label: str | None = None) -> DataFrame:
    """Long rows (row, feature, value) as one row each with columns x<feature>; absent entries are 0. Centring makes such data dense."""
    from pyspark.sql import functions as F

    some = [F.sum(F.when(F.col(feature) == j, F.col(value)).otherwise(0.0)).alias(f"x{j}") for j in features]
    return df.groupBy(row).agg(*some, *([F.first(label).alias(label)] if label else []))
