"""One row per key: the latest, the first, or the best by an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key. An aggregation, not a window: it is combined
    before the shuffle, so a hot key doesn't reach one task row by row, and nothing is sorted."""
    best = F.max_by(F.struct(*keep), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, *[F.col("_best")[c].alias(c) for c in keep])


def first_per(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    best = F.min_by(F.struct(*keep), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, *[F.col("_best")[c].alias(c) for c in keep])


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
