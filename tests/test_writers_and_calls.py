"""Concurrent writers of versioned tables, and calls that fail, are late or hang."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from quillwork.operators import external, versions


@pytest.fixture
def tables(spark, tmp_path):
    return versions.Versioned(spark, f"file://{tmp_path}/tables", {"jobs": "id", "log": "n"})


def jobs(spark, rows):
    return spark.createDataFrame(rows, "id long, state string")


def now(tables, version=None):
    return {r["id"]: r["state"] for r in tables.read("jobs", version).collect()}


def test_of_two_writers_on_one_version_one_retries_and_no_row_is_lost(spark, tables):
    tables.change(lambda t: t.write("jobs", jobs(spark, [(1, "queued"), (2, "queued"), (3, "queued")])))
    a, b = tables.begin(), tables.begin()
    a.write("jobs", jobs(spark, [(1, "a")]))
    b.write("jobs", jobs(spark, [(1, "b"), (2, "b")]))
    assert a.commit() == 2
    with pytest.raises(versions.Conflict):
        b.commit()
    assert now(tables) == {1: "a", 2: "queued", 3: "queued"}
    runs = []

    def claim(t):
        runs.append(t.base)
        if len(runs) == 1:  # another writer comes first, once
            other = tables.begin()
            other.write("jobs", jobs(spark, [(2, "other")]))
            other.commit()
        free = t.read("jobs").filter("state = 'queued'").orderBy("id").limit(1)
        t.write("jobs", free.withColumn("state", F.lit("mine")))

    tables.change(claim)
    assert runs == [2, 3] and now(tables) == {1: "a", 2: "other", 3: "mine"}
    assert now(tables, 1) == {1: "queued", 2: "queued", 3: "queued"}  # old versions stay


def test_writers_of_other_keys_or_tables_both_succeed(spark, tables):
    tables.change(lambda t: t.write("jobs", jobs(spark, [(1, "x"), (2, "x")])))
    a, b, c = (tables.begin() for _ in range(3))
    a.write("jobs", jobs(spark, [(1, "a")]))
    b.write("jobs", jobs(spark, [(2, "b")]).withColumn("gone", F.lit(True)))
    c.write("log", spark.createDataFrame([(7,)], "n long"))
    assert [a.commit(), b.commit(), c.commit()] == [2, 3, 4]
    assert now(tables) == {1: "a"} and tables.read("log").count() == 1 and tables.read("log", 3) is None


def test_many_threads_create_each_entry_once(spark, tmp_path):
    won, path = [], f"file://{tmp_path}/log/1.json"

    def race(i):
        if versions._create(spark, path, f'{{"by": {i}}}'):
            won.append(i)

    threads = [threading.Thread(target=race, args=(i,)) for i in range(16)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and spark.read.text(path).first()["value"] == f'{{"by": {won[0]}}}'


def test_whole_tables_bound_what_a_read_unions(spark, tables, monkeypatch):
    monkeypatch.setattr(versions, "EVERY", 3)
    for i in range(8):
        tables.change(lambda t, i=i: t.write("jobs", jobs(spark, [(i % 5, f"v{i}")]).withColumn("gone", F.lit(i == 6))))
    assert now(tables) == {0: "v5", 2: "v7", 3: "v3", 4: "v4"} and now(tables, 6) == {0: "v5", 1: "v1", 2: "v2", 3: "v3", 4: "v4"}
    whole, changes = tables._sets("jobs", 8)
    assert whole and len(changes) == 2


def test_calls_that_hang_hold_no_row_and_no_task(spark):
    def call(text, attempt):
        if text == "hangs":
            while not external.stopped():  # told to stop, it ends
                time.sleep(0.05)
        if text == "deaf":
            time.sleep(4)
        if text == "late first" and attempt == 1:
            time.sleep(1)
        return text.upper()

    rows = spark.createDataFrame([(i, x) for i, x in enumerate(["a", "hangs", "b", "late first", "deaf", "c"] + ["d"] * 50)], "i int, s string").coalesce(1)
    began = time.monotonic()
    got = {r["i"]: r for r in external.answered(rows, "s", call, in_flight=2, attempts=2, seconds=0.4).collect()}
    assert time.monotonic() - began < 20
    assert [got[i]["answer"] for i in range(6)] == ["A", None, "B", "LATE FIRST", None, "C"] and all(got[i]["answer"] == "D" for i in range(6, 56))
    assert got[1]["error"].startswith("Timeout") and got[3]["attempts"] == 2 and got[4]["attempts"] == 2


def test_a_row_keeps_what_arrived_of_its_calls(spark):
    def fails(text, attempt):
        raise ValueError("no")

    def slow(text, attempt):
        if text == "two":
            time.sleep(3)
        return "slow"

    asked = {"size": lambda text, attempt: str(len(text)), "fails": fails, "slow": slow}
    rows = spark.createDataFrame([(1, "one"), (2, "two"), (3, None)], "i int, s string").coalesce(1)
    got = {r["i"]: r for r in external.fanned_out(rows, "s", asked, seconds=0.5).collect()}
    assert [[(a["call"], a["answer"], (a["error"] or "")[:7]) for a in got[i]["answers"]] for i in (1, 2, 3)] == [
        [("size", "3", ""), ("fails", None, "ValueEr"), ("slow", "slow", "")],
        [("size", "3", ""), ("fails", None, "ValueEr"), ("slow", None, "Timeout")],
        [("size", "0", ""), ("fails", None, "ValueEr"), ("slow", "slow", "")],
    ]
    assert not any(r["complete"] for r in got.values())
    assert all(r["complete"] for r in external.fanned_out(rows, "s", {"size": asked["size"]}).collect())


def test_no_further_calls_while_too_many_hang():
    with external.Calls(4, 1, 0.1, hanging=2) as calls:
        hang = threading.Event()
        out = [calls.submit(lambda text, attempt: hang.wait(5) and "x", "t") for _ in range(2)]
        assert all(f.result()[1].startswith("Timeout") for f in out)
        assert calls.submit(lambda text, attempt: "y", "t").result()[1].startswith("Unavailable")
        hang.set()
        time.sleep(0.3)
        assert calls.submit(lambda text, attempt: "y", "t").result() == ("y", None, 1)


def test_vectors_are_encoded_once_for_each_text_and_model(spark, tmp_path):
    from quillwork.operators.vector_cache import cached_vectors

    folder, log = f"file://{tmp_path}/vectors", tmp_path / "calls"
    log.mkdir()

    def encoder(texts):
        import os
        import uuid

        for x in texts:
            with open(os.path.join(str(log), uuid.uuid4().hex), "w") as f:
                f.write(x)
        return None if "bad" in texts else [[float(len(x)), 0.0] for x in texts]

    calls = lambda: sorted(p.read_text() for p in log.iterdir())
    rows = lambda *texts: spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string").repartition(2, "s")
    got = {r["i"]: (r["vector"], r["encoder"]) for r in cached_vectors(rows("a", "bb", "a", None), "s", folder, 2, encoder, "m").collect()}
    assert got == {0: ([1.0, 0.0], "m"), 1: ([2.0, 0.0], "m"), 2: ([1.0, 0.0], "m"), 3: ([0.0, 0.0], "m")} and calls() == ["", "a", "bb"]
    got = {r["i"]: r["vector"] for r in cached_vectors(rows("a", "ccc"), "s", folder, 2, encoder, "m").collect()}
    assert got == {0: [1.0, 0.0], 1: [3.0, 0.0]} and calls() == ["", "a", "bb", "ccc"]
    cached_vectors(rows("a"), "s", folder, 2, encoder, "other").collect()
    assert calls().count("a") == 2  # another model has vectors of its own
    bad = cached_vectors(rows("bad"), "s", folder, 2, encoder, "m", attempts=1).collect()
    assert bad[0]["encoder"] == "hashed" and spark.read.parquet(folder).count() == 5  # asked again by the next run
