"""A work queue: what is due, how a job's state moves, and both as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST_ATTEMPTS = 3
RETRY_DELAY_S = 120
LEASE_S = 900


def due(jobs: DataFrame, at: str, tie: str, now: str, most_attempts: int, each: int, key: str) -> DataFrame:
    """The oldest due jobs of each key in the order to claim them; jobs out of attempts aren't due."""
    ready = jobs.filter((F.col("attempts") < most_attempts) & (F.col(at) < F.lit(now).cast("timestamp_ntz")))
    return ready.withColumn("slot", F.row_number().over(Window.partitionBy(key).orderBy(at, tie))).filter(F.col("slot") <= each)


def step(state: tuple, event_type: str, at: float, value: float) -> tuple:
    """(status, attempts, progress, since) after one event: click claims, view reports progress, error
    fails the attempt, purchase completes. A claim that has been silent for LEASE_S is lost first."""
    status, attempts, progress, since = state
    if status == "running" and at - since > LEASE_S:
        status = "queued" if attempts < MOST_ATTEMPTS else "failed"
    if event_type == "click" and status == "queued" and at >= since:
        return "running", attempts + 1, progress, at
    if event_type == "view" and status == "running":
        return status, attempts, max(progress, min(99, int(value))), at
    if event_type == "error" and status == "running":
        return ("queued", attempts, progress, at + RETRY_DELAY_S) if attempts < MOST_ATTEMPTS else ("failed", attempts, progress, at)
    if event_type == "purchase" and status == "running":
        return "complete", attempts, 100, at
    return status, attempts, progress, since


START = ("queued", 0, 0, 0.0)


def fold_jobs(events: DataFrame) -> DataFrame:
    """The state of each job after all of its events, in order of time and id."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state = START
        for kind, ts, value in pdf.sort_values(["ts", "event_id"])[["event_type", "ts", "value"]].itertuples(index=False):
            state = step(state, kind, ts.timestamp(), value)
        return pd.DataFrame([(pdf["job"].iloc[0], *state[:3])], columns=["job", "status", "attempts", "progress"])

    return events.groupBy("job").applyInPandas(run, "job long, status string, attempts long, progress long")


def job_stream(events: DataFrame) -> DataFrame:
    """The same as a stream: the state is kept by key, an update is emitted a batch, and a job that
    stays silent past its lease is put back by a timer."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else START
        if state.hasTimedOut:
            now = ("queued" if now[1] < MOST_ATTEMPTS else "failed", *now[1:])
        for pdf in batches:
            for kind, ts, value in pdf.sort_values(["ts", "event_id"])[["event_type", "ts", "value"]].itertuples(index=False):
                now = step(now, kind, ts.timestamp(), value)
        state.update(now)
        if now[0] == "running":
            state.setTimeoutDuration(LEASE_S * 1000)
        yield pd.DataFrame([(key[0], *now[:3])], columns=["job", "status", "attempts", "progress"])

    return events.groupBy("job").applyInPandasWithState(
        run, "job long, status string, attempts long, progress long", "status string, attempts long, progress long, since double", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def sessions_stream(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Idle-gap sessions of each user; a session is final once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def enqueue_once(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """First of each key within the watermark: enqueueing twice is enqueueing once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
