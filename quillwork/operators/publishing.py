"""Several tables as one: all are written to a new version, and readers see a version by its manifest only."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> str:
    """Writes the tables, then the manifest that makes them visible, all or none: a version whose write
    fails has no manifest. Returns the version."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    line = json.dumps({"version": version, "tables": sorted(tables)})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{folder}/manifest")
    return version


def published(spark: SparkSession, folder: str, name: str, version: str) -> DataFrame:
    """A table of a version that has been published; others are refused."""
    known = spark.read.schema("version string, tables array<string>").json(f"{folder}/manifest")
    if not known.filter(known.version == version).selectExpr(f"array_contains(tables, '{name}') as held").filter("held").count():
        raise ValueError(f"{name} of {version} isn't published")
    return spark.read.parquet(f"{folder}/{version}/{name}")
