"""The live forms against the batch forms, on files that arrive one after another."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from quillwork.streaming import queue, worker


@pytest.fixture()
def arriving(spark, small, tmp_path):
    """A stream of the events in three files by time, and the same as a table."""
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    step = (hi - lo) / 3
    folder = str(tmp_path / "events")
    for i in range(3):
        upper = F.lit(True) if i == 2 else F.col("ts") < F.lit(lo + step * (i + 1))
        events.filter((F.col("ts") >= F.lit(lo + step * i)) & upper).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return stream, events


def run(df, tmp_path, mode: str):
    name = f"s{uuid.uuid4().hex}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(180)
    finally:
        q.stop()
    return df.sparkSession.table(name).collect()


def test_enqueueing_twice_is_enqueueing_once(arriving, tmp_path):
    stream, events = arriving
    rows = run(queue.enqueue_once(stream, ["user_id", "event_type"], "60 days"), tmp_path, "append")
    found = [(r.user_id, r.event_type) for r in rows]
    assert len(found) == len(set(found))
    assert set(found) == {(r.user_id, r.event_type) for r in events.select("user_id", "event_type").distinct().collect()}


def test_sessions_are_those_of_the_batch(arriving, tmp_path):
    stream, events = arriving
    rows = run(queue.sessions_stream(stream, "6 hours", "0 seconds"), tmp_path, "append")
    batch = events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()
    want = {(r.user_id, r.w.start, r.w.end, r.n) for r in batch}
    found = {(r.user_id, r.w.start, r.w.end, r.n) for r in rows}
    # Files hold their events in order of time, so only sessions that cross a file's end may differ.
    assert found and len(found - want) <= 0.2 * len(want)


def test_job_states_end_as_in_the_batch(spark, small, tmp_path):
    """Files arrive one after another, a run each, on one checkpoint: the state goes on where it was."""
    events = spark.read.parquet(f"{small}/events.parquet").select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value").filter("job % 5 = 0")
    middle = events.agg(F.expr("percentile_approx(unix_micros(ts), 0.5)")).first()[0]
    folder, last = str(tmp_path / "events"), {}

    def keep(batch, _) -> None:
        last.update({r.job: tuple(r) for r in batch.collect()})

    for part in (F.unix_micros("ts") < middle, F.unix_micros("ts") >= middle):
        events.filter(part).coalesce(1).write.mode("append").parquet(folder)
        stream = queue.job_stream(spark.readStream.schema(events.schema).parquet(folder))
        # One batch a run: timers of processing time would keep an open-ended run going.
        q = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        try:
            assert q.awaitTermination(120)
        finally:
            q.stop()
    assert last == {r.job: tuple(r) for r in queue.fold_jobs(events).collect()}


def test_steps_of_a_job():
    state = queue.START
    state = queue.step(state, "click", 100, 0)
    assert state == ("running", 1, 0, 100)
    assert queue.step(state, "click", 150, 0) == state  # claimed once
    state = queue.step(state, "view", 200, 40)
    state = queue.step(state, "view", 210, 12)
    assert state[2] == 40  # progress never falls
    assert queue.step(state, "view", 220, 500)[2] == 99
    failed = queue.step(state, "error", 230, 0)
    assert failed == ("queued", 1, 40, 230 + queue.RETRY_DELAY_S)
    assert queue.step(failed, "click", 240, 0) == failed  # not due yet
    again = queue.step(failed, "click", 400, 0)
    assert again[:2] == ("running", 2)
    lost = queue.step(again, "view", 400 + queue.LEASE_S + 1, 50)
    assert lost[0] == "queued"  # the lease was lost before the late report
    assert queue.step(again, "purchase", 500, 0) == ("complete", 2, 100, 500)
    last = ("running", queue.MOST_ATTEMPTS, 10, 0.0)
    assert queue.step(last, "error", 10, 0)[0] == "failed"
    assert queue.step(last, "view", queue.LEASE_S + 1, 0)[0] == "failed"


def test_a_worker_goes_on_where_it_stood_and_counts_a_batch_once(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("jobs", "out", "checkpoint"))
    add = lambda ids: spark.createDataFrame([(i, f"job {i}") for i in ids], "job long, text string").coalesce(1).write.mode("append").parquet(folder)
    tries = []

    def work(rows):
        tries.append(sorted(r.job for r in rows.collect()))
        if len(tries) == 2:
            raise RuntimeError("lost")
        return rows.select("job", F.upper("text").alias("done"), F.lit(len(tries)).alias("try"))

    def go(fails: bool = False) -> None:
        stream = spark.readStream.schema("job long, text string").option("maxFilesPerTrigger", 1).parquet(folder)
        query = worker.start_worker(stream, work, out, checkpoint, once=True)
        if fails:
            with pytest.raises(Exception, match="lost"):
                query.awaitTermination(120)
        else:
            assert query.awaitTermination(120)

    add(range(3))
    go()
    add(range(3, 5))
    go(fails=True)
    go()
    add([0])  # a job that is queued again
    go()
    assert tries == [[0, 1, 2], [3, 4], [3, 4], [0]]
    found = {r.job: (r.done, r["try"]) for r in worker.results(spark, out, "job").collect()}
    assert found == {0: ("JOB 0", 4), 1: ("JOB 1", 1), 2: ("JOB 2", 1), 3: ("JOB 3", 3), 4: ("JOB 4", 3)}
