"""Folds and numberings that don't hold a group in one task's memory."""

from __future__ import annotations

import numpy as np
import pytest

from quillwork.operators import folding
from quillwork.plans import registry, streams


def clusters(rows: list[tuple], least: float, bonus: float) -> dict:
    """The fold as plain code."""
    out, state = {}, {}
    for label, i, v in sorted(rows, key=lambda r: r[1]):
        sums, last = state.get(label, ([], -1))
        v = np.array(v)
        scores = [float(v @ s / (np.linalg.norm(s) * np.linalg.norm(v) or 1)) + bonus * (k == last) for k, s in enumerate(sums)]
        best = int(np.argmax(scores)) if scores else -1
        if best >= 0 and scores[best] >= least:
            sums[best] = sums[best] + v
        else:
            best = len(sums)
            sums.append(v)
        state[label] = sums, best
        out[label, i] = best
    return out


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_online_clusters_stream_in_order(spark, batch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(15, 8))
    rows = [(int(i % 3), i, (centres[rng.integers(15)] + 0.5 * rng.normal(size=8)).tolist()) for i in range(300)] + [(3, 900, [0.0] * 8), (3, 901, [0.0] * 8)]
    vectors = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "label int, vec_id long, embedding array<double>")
    default = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = folding.online_centroids(vectors, 0.5, 0.035)
        plan = found._jdf.queryExecution().toString()
        assert "FlatMapGroups" not in plan  # no whole label as one frame
        assert {(r.label, r.vec_id): r.cluster for r in found.collect()} == clusters(rows, 0.5, 0.035)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", default)


def test_batches_number_a_source_over_several_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "ID_RANGE", 50)
    rows = [(3 * i - 90, None if i % 5 == 0 else "hot" if i % 5 < 4 else "cold") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, source string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    seen, want = {}, set()
    for doc, source in sorted(rows):
        seen[source] = seen.get(source, -1) + 1
        want.add((doc, seen[source] // 20, source))
    df = registry.QUERIES["embedding_batches"](spark, str(tmp_path))
    assert {tuple(r) for r in df.collect()} == want and df.count() == len(rows)
