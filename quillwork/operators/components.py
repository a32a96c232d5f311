"""Connected components of a graph of links."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which the driver and all executors see; a local
    temporary folder only where a local session has no such setting, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/quillwork"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Has a written folder deleted when the application ends, which reads it until then."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)


def written(df: DataFrame) -> DataFrame:
    """A step's result in the folder that all executors share, for as long as the application runs."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    gone_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(links: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of every node with a link (a, b); nodes of any ordered
    type. Every node takes the least root around it, then its root's root, until none changes: long
    chains take a logarithmic number of rounds, and each round is a few joins of the links' size."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        around = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        near = roots.join(around, "node").select("node", "root", F.least("root", "r").alias("next"))
        jump = near.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = written(near.join(jump, "next", "left").select("node", "root", F.least("next", F.coalesce("far", "next")).alias("next")))
        done = new.filter("root <> next").isEmpty()
        roots = new.select("node", F.col("next").alias("root"))
        if done:
            return roots
