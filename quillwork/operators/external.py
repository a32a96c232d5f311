"""Calls out of the engine: services, scripts and posts, as operators of a partition.

A call is a function of one text and the number of its attempt. Calls of a batch run a bounded number
at a time and answer in the order of their rows. Each attempt has a time limit: an answer that comes later is
dropped, the call is told to stop, and its place is given to the next one, so a call that hangs holds neither
its row nor its task; a process is killed. A row is never lost: its error stands in place of its answer.
Answers are kept by text, up to a bound, so that a repeated text costs one call a worker.

``fanned_out`` asks several calls about each row at once and keeps what arrived: a row has every call's answer or
error, in the order of the calls, and whether all answered.
"""

from __future__ import annotations

import json
import queue
import subprocess
import sys
import threading
from collections import OrderedDict
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

#: Answers that a worker remembers.
REMEMBERED = 10_000


class Stopped(threading.local):
    """Within a call: ``stopped()`` tells whether its time is over, for calls that can end early."""

    event: threading.Event | None = None

    def __call__(self) -> bool:
        return self.event is not None and self.event.is_set()


stopped = Stopped()


class Calls:
    """Runs calls in threads of their own, ``in_flight`` at a time, each attempt within ``seconds``.

    A thread can't be killed, so one whose time is over is left to itself and no longer counted. Should as many as
    ``hanging`` be left at once, further calls get an error without being made until some have ended; with none
    given, every call is made."""

    def __init__(self, in_flight: int, attempts: int, seconds: float, hanging: int | None = 64):
        self.attempts, self.seconds, self.hanging = attempts, seconds, hanging
        self.pool = ThreadPoolExecutor(in_flight)
        self.left, self.lock = 0, threading.Lock()

    def __enter__(self) -> Calls:
        return self

    def __exit__(self, *_: object) -> None:
        self.pool.shutdown(wait=True)  # its threads only wait for calls, each no longer than its time

    def submit(self, call: Callable[[str, int], str], text: str | None) -> Future:
        return self.pool.submit(self._tried, call, text or "")

    def _tried(self, call: Callable[[str, int], str], text: str) -> tuple[str | None, str | None, int]:
        said = None
        for attempt in range(1, self.attempts + 1):
            answer, said = self._once(call, text, attempt)
            if said is None:
                return answer, None, attempt
        return None, said, self.attempts

    def _once(self, call: Callable[[str, int], str], text: str, attempt: int) -> tuple[str | None, str | None]:
        with self.lock:
            if self.hanging is not None and self.left >= self.hanging:
                return None, "Unavailable: too many calls hang"
        got: queue.SimpleQueue = queue.SimpleQueue()
        event = threading.Event()

        def run() -> None:
            stopped.event = event
            try:
                out = (call(text, attempt), None)
            except Exception as e:  # whatever a service raises is its answer to that attempt
                out = (None, f"{type(e).__name__}: {e}")
            with self.lock:
                got.put(out)
                self.left -= event.is_set()

        threading.Thread(target=run, daemon=True).start()
        try:
            return got.get(timeout=self.seconds)
        except queue.Empty:
            with self.lock:
                if not got.empty():
                    return got.get()
                event.set()
                self.left += 1
            return None, f"Timeout: no answer in {self.seconds:g} s"


def answered(rows: DataFrame, column: str, call: Callable[[str, int], str], in_flight: int = 8, attempts: int = 3, seconds: float = 60.0) -> DataFrame:
    """``rows`` with answer, error and attempts of a call on each text of ``column``."""
    schema = StructType([*rows.schema.fields, StructField("answer", StringType()), StructField("error", StringType()), StructField("attempts", IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: OrderedDict[str | None, tuple] = OrderedDict()
        with Calls(in_flight, attempts, seconds) as calls:
            for b in batches:
                texts = [None if pd.isna(x) else x for x in b[column]]
                new = {x: calls.submit(call, x) for x in dict.fromkeys(texts) if x not in known}
                known.update((x, f.result()) for x, f in new.items())
                answers = list(zip(*map(known.__getitem__, texts), strict=True)) or [[], [], []]
                yield b.assign(answer=answers[0], error=answers[1], attempts=answers[2])
                while len(known) > REMEMBERED:
                    known.popitem(last=False)

    return rows.mapInPandas(run, schema)


#: Rows whose calls and answers a task holds at once.
ASKED_ROWS = 256


def fanned_out(rows: DataFrame, column: str, asked: dict[str, Callable[[str, int], str]], in_flight: int = 8, attempts: int = 1, seconds: float = 60.0) -> DataFrame:
    """``rows`` with ``answers``, an array of (call, answer, error, attempts) in the order of ``asked``, and ``complete``: all
    calls on a row's text are made at once, none waits for another, and what fails or is late leaves the others as they are.
    Every call of every row is made, however many hang: these come up at most ``in_flight`` at a time, each after its time."""
    one = StructType([StructField("call", StringType()), StructField("answer", StringType()), StructField("error", StringType()), StructField("attempts", IntegerType())])
    schema = StructType([*rows.schema.fields, StructField("answers", ArrayType(one)), StructField("complete", BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Calls(in_flight, attempts, seconds, hanging=None) as calls:
            for b in (whole.iloc[i : i + ASKED_ROWS] for whole in batches for i in range(0, len(whole), ASKED_ROWS)):
                sent = [{name: calls.submit(call, None if pd.isna(x) else x) for name, call in asked.items()} for x in b[column]]
                got = [[{"call": name, **dict(zip(("answer", "error", "attempts"), f.result(), strict=True))} for name, f in row.items()] for row in sent]
                yield b.assign(answers=got, complete=[all(x["error"] is None for x in row) for row in got])

    return rows.mapInPandas(run, schema)


def first_error(answers: DataFrame, order: str) -> DataFrame:
    """The error of the least ``order``, whatever finished first: one row, or none."""
    failed = answers.filter("error is not null")
    return failed.agg(F.min(F.struct(order, "error")).alias("e")).filter("e is not null").select(f"e.{order}", "e.error")


def scripted(rows: DataFrame, column: str, script: str, seconds: float = 30.0, batch: int = 200) -> DataFrame:
    """``rows`` with the answer of a Python script to each text: a process takes a JSON list of texts and
    prints a JSON list of answers. One that takes too long is killed, and its rows have its error."""
    schema = StructType([*rows.schema.fields, StructField("answer", StringType()), StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), batch):
                part = b.iloc[start : start + batch]
                texts = ["" if pd.isna(x) else x for x in part[column]]
                try:
                    done = subprocess.run([sys.executable, "-c", script], input=json.dumps(texts), capture_output=True, text=True, timeout=seconds, check=True)
                    answers = [json.dumps(x) for x in json.loads(done.stdout)]
                    error = None if len(answers) == len(part) else "not an answer for each text"
                except subprocess.TimeoutExpired:
                    error = "timeout"
                except (subprocess.CalledProcessError, json.JSONDecodeError) as e:
                    error = type(e).__name__
                yield part.assign(answer=[None] * len(part) if error else answers, error=error)

    return rows.mapInPandas(run, schema)


def posted(rows: DataFrame, post: Callable[[list[dict]], int], batch: int = 100, attempts: int = 3) -> DataFrame:
    """Posts rows as lists of records and returns a status a row: the code of the post that carried it. A
    task that is run again posts again, so a receiver takes a record by its key."""
    schema = StructType([*rows.schema.fields, StructField("status", IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), batch):
                part, code = b.iloc[start : start + batch], 0
                for _ in range(attempts):
                    code = post(part.to_dict("records"))
                    if code < 500:
                        break
                yield part.assign(status=code)

    return rows.mapInPandas(run, schema)
