"""specialists read every turn whole, and calls that hang leave no other call unmade."""

from __future__ import annotations

import time

import duckdb

from quillwork.operators import external
from quillwork.plans import registry

LONG = "word " * 400
#: A turn each, and what the readers of actions, decisions and risks find in it.
TURNS = (
    (LONG + "i'll send it", (True, False, False)), (LONG + "Agreed, the risk is small", (False, True, True)), (LONG, (False, False, False)),
    ("Fine, we will see", (True, True, False)), ("éfine, no issueé", (False, True, True)), (None, (False, False, False)),
)


def test_long_turns_are_read_to_their_end(spark, tmp_path):
    rows = [(1, i, "user", text) for i, (text, _) in enumerate(TURNS)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in registry.QUERIES["specialists"](spark, str(tmp_path)).select("conv_id", "turn", "specialist", "outcome", "complete").collect()]
    named = ("actions", "decisions", "risks")
    assert sorted(got) == sorted((1, i, n, "found" if hit else "nothing", True) for i, (_, hits) in enumerate(TURNS) for n, hit in zip(named, hits, strict=True))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.sql(f"select conv_id, turn, specialist, outcome, complete from ({registry.ORACLE_SQL['specialists']}) q").fetchall()
    assert sorted(got) == sorted(want)


def test_all_calls_are_made_though_many_hang(spark):
    def call(text, attempt):
        if text == "deaf":
            time.sleep(3)
        return text

    rows = spark.createDataFrame([(i, "deaf" if i < 70 else "heard") for i in range(300)], "i int, s string").coalesce(1)
    got = {r["i"]: r["answers"][0] for r in external.fanned_out(rows, "s", {"one": call}, in_flight=35, seconds=0.5).collect()}
    assert all(got[i]["error"].startswith("Timeout") for i in range(70))
    assert [got[i]["answer"] for i in range(70, 300)] == ["heard"] * 230
