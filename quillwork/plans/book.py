"""A module's queries: functions of (spark, tables) registered with the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillwork.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


class Book:
    def __init__(self) -> None:
        self.found: dict[str, Query] = {}

    def __call__(self, covers: str, sql: str | None = None) -> Callable:
        """covers: the survey's operator numbers, separated by spaces."""

        def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.found[f.__name__] = Query(lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql, tuple(covers.split()))
            return f

        return add
