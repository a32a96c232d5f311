"""Keyed state as a stream, decision graphs, mergeable clusters and the index that grows."""

from __future__ import annotations

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.operators import summaries, vector_index
from quillwork.operators.retrieval import best_rows
from quillwork.operators.summaries import merged_clusters
from quillwork.streaming import drafts


def plain_drafts(rows):
    out = set()
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for draft, events in by.items():
        version, held, ahead = 0, None, None
        for _, seq, ts, kind, value in sorted(events, key=lambda e: (e[2], e[1])):
            outcome = kind
            if kind == "write":
                version, held = version + 1, value
            elif kind == "ahead":
                ahead = (version, ts)
            else:
                outcome = "fresh" if ahead is None else "stale" if ahead[0] != version else "expired" if ts > ahead[1] + drafts.TTL_S else "used"
            out.add((draft, seq, version, held, outcome))
    return out


def draft_rows():
    rng = random.Random(2)
    rows = [(d, i, 1_700_000_000 + rng.randrange(0, 200_000), rng.choice(["write", "ahead", "ask", "ask"]), round(rng.random(), 3)) for i, d in enumerate(rng.choice([1, 2, 3, 4, 4, 4]) for _ in range(240))]
    return rows + [(9, 1000, 1_700_000_000, "ask", 0.0), (9, 1001, 1_700_000_000, "ahead", 0.0), (9, 1002, 1_700_000_000 + drafts.TTL_S, "ask", 0.0), (9, 1003, 1_700_000_001 + drafts.TTL_S, "ask", 0.0)]


DDL = "draft long, seq long, ts long, kind string, value double"


def test_drafts_replayed_equal_a_plain_fold(spark):
    rows = draft_rows()
    df = spark.createDataFrame(rows, DDL).withColumn("ts", F.timestamp_seconds("ts"))
    got = {tuple(r) for r in drafts.replayed(df).collect()}
    assert got == plain_drafts(rows) and {r[4] for r in got} == {"write", "ahead", "fresh", "stale", "expired", "used"}


def test_the_stream_of_drafts_gives_the_same_also_for_late_events(spark, tmp_path):
    rows = draft_rows()
    rng = random.Random(5)
    # Files in the order of time, but events come up to an hour late: some in a later file than others of a later time.
    late = sorted(rows, key=lambda r: r[2] + rng.randrange(0, 3500))
    parts = [late[i : i + 50] for i in range(0, len(late), 50)]
    parts.append([(99, 5000, 1_800_000_000, "ask", 0.0)])  # moves the watermark past all others
    parts.append([(99, 5001, 1_800_100_000, "ask", 0.0)])
    source, before = tmp_path / "source", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in parts:
            spark.createDataFrame(part, DDL).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(str(source))
            time.sleep(1.1)  # the source takes files in the order of their times
        stream = spark.readStream.schema("draft long, seq long, ts timestamp, kind string, value double").option("maxFilesPerTrigger", 1).parquet(str(source))
        query = drafts.drafts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).filter("draft < 99").select("draft", "seq", "version", "held", "outcome").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_drafts(rows)


def test_mergeable_clusters_find_what_belongs_together(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    which = rng.integers(0, 12, 1500)
    x = centres[which] + 0.15 * rng.normal(size=(1500, 16))
    # One group holds nearly all rows; its ranges are many tasks'.
    rows = [("hot" if i % 15 else "cold", i, v.tolist()) for i, v in enumerate(x)] + [("null", 5000, None), (None, 5001, [1.0] * 16)]
    df = spark.createDataFrame(rows, "grp string, id long, v array<double>")
    one = merged_clusters(df, 0.7, rows_of_range=100, fan=3)
    got = {(r["grp"], r["id"]): r["cluster"] for r in one.collect()}
    assert set(got) == {("hot" if i % 15 else "cold", i) for i in range(1500)}
    for grp in ("hot", "cold"):
        pairs = Counter((which[i], c) for (g, i), c in got.items() if g == grp)
        assert len(pairs) == 12 == len({c for _, c in pairs})  # a cluster for each centre
    again = {(r["grp"], r["id"]): r["cluster"] for r in merged_clusters(df.repartition(7), 0.7, rows_of_range=100, fan=3).collect()}
    assert again == got


@pytest.mark.parametrize("ranges", [64, 4096])
def test_clusters_of_ranges_agree_with_those_of_all_rows(spark, small, ranges):
    """Pairs of a label that are together in both or apart in both, against one range of all rows."""
    v = spark.read.parquet(f"{small}/embeddings.parquet").select(F.lit("all").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    a = {r["id"]: r["cluster"] for r in merged_clusters(v, 0.5, rows_of_range=1 << 40).collect()}
    b = {r["id"]: r["cluster"] for r in merged_clusters(v, 0.5, rows_of_range=ranges).collect()}
    ids = sorted(a)
    same = sum((a[i] == a[j]) == (b[i] == b[j]) for k, i in enumerate(ids) for j in ids[:k])
    assert set(a) == set(b) and same >= 0.9 * len(ids) * (len(ids) - 1) / 2


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_the_growing_index_finds_nine_of_ten_and_scores_a_tenth(spark, sf):
    v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    asked = v.filter("vec_id % 20 = 0")
    index = vector_index.build(v)
    found, scored = vector_index.search(index, asked, v, 10)
    true = {(r["q"], r["vec_id"]) for r in best_rows(asked, v, 10).collect()}
    got = {(r["q"], r["vec_id"]) for r in found.collect()}
    rows, queries = v.count(), asked.count()
    assert len(true & got) >= 0.9 * len(true)
    assert scored.count() <= 0.1 * rows * queries
    # Every row is in one list, and cells grow with the square root of rows.
    ids = [i for r in index.lists.collect() for i in np.frombuffer(r["ids"], np.int64).tolist()]
    assert sorted(ids) == sorted(r["vec_id"] for r in v.select("vec_id").collect())
    assert 0.5 * rows**0.5 <= index.fine.count() <= 2 * rows**0.5


def test_an_index_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (None, [1.0, 1.0]), (5, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, _ = vector_index.search(vector_index.build(v), v.filter("vec_id = 1"), v, 2, looked=1.0)
    assert [tuple(r) for r in found.orderBy("vec_id").collect()] == [(1, 1, 1.0), (1, 2, 1.0)]
    none = v.filter("vec_id > 99")
    assert vector_index.search(vector_index.build(none), none, none, 2)[0].count() == 0


def test_centres_go_to_spans_of_ranges(spark, small, monkeypatch):
    v = spark.read.parquet(f"{small}/embeddings.parquet").select(F.lit("all").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = []
    for span in (1, 16):
        monkeypatch.setattr(summaries, "SPAN", span)
        df = merged_clusters(v, 0.5, rows_of_range=64)
        assert "span" in df._jdf.queryExecution().optimizedPlan().toString()
        found.append(sorted(map(tuple, df.collect())))
    assert found[0] == found[1] and found[0]
