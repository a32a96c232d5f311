"""A worker of a queue as a streaming query: it polls, does a batch of jobs, and commits their results.

A batch's results are written to a folder of its number, overwriting what an earlier try of the same batch
left, so a batch that is done again after a failure counts once. Where the worker stood is in the
checkpoint; a worker that is started again goes on behind the last batch that it committed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

POLL_SECONDS = 5


def start_worker(jobs: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """jobs: a stream of jobs; work: rows of a batch to their results. Polls every ``POLL_SECONDS``, or
    takes what there is and ends."""

    def batch(rows: DataFrame, number: int) -> None:
        work(rows).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    trigger = {"availableNow": True} if once else {"processingTime": f"{POLL_SECONDS} seconds"}
    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def results(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The results of all batches, the last one of each job."""
    found = spark.read.parquet(folder)
    last = F.max_by(F.struct(*[c for c in found.columns if c not in (key, "batch")]), "batch").alias("r")
    return found.groupBy(key).agg(last).select(key, "r.*")
