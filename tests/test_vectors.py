"""Vector searches against brute force."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pytest

from quillwork.operators import retrieval
from quillwork.plans import registry

N, DIMS = 400, 16


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Vectors of which many are equal; the labels 7 to 9 begin after id 100."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(N, DIMS)).astype(np.float32)
    x[50:90] = x[50]
    labels = [i % 7 if i < 100 else i % 10 for i in range(N)]
    path = tmp_path_factory.mktemp("vectors")
    spark.createDataFrame([(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{path}/embeddings.parquet")
    return str(path), x.astype(float), np.array(labels)


@pytest.mark.parametrize("block", [4096, 7])
def test_every_twentieth_row_is_a_query_against_all_rows(spark, table, monkeypatch, block):
    monkeypatch.setattr(retrieval, "ASKED_BLOCK", block)
    monkeypatch.setattr(retrieval, "ROWS_BLOCK", block)
    path, x, _ = table
    want = set()
    for q in range(0, N, 20):
        scores = np.round(x @ x[q], 4)
        want |= {(q, i, float(scores[i])) for i in sorted(range(N), key=lambda i: (-scores[i], i))[:8]}
    found = registry.QUERIES["vector_top_k_all"](spark, path).collect()
    assert {(r.q, r.vec_id, r.score) for r in found} == want and len(found) == len(want)


def test_every_label_has_prototypes(spark, table):
    path, x, labels = table
    prototypes = {g: x[np.flatnonzero(labels == g)[:2]] for g in range(10)}
    want = set()
    for i, v in enumerate(x):
        best = sorted((-(p @ v).max(), g) for g, p in prototypes.items() if (p @ v).max() > 0)[:3]
        want |= {(i, g, n, round(-s, 3)) for n, (s, g) in enumerate(best, 1)}
    found = registry.QUERIES["top_k_label_prototypes"](spark, path).collect()
    assert {r.label for r in found} == set(range(10))
    assert {(r.vec_id, r.label, r.rank) for r in found} == {w[:3] for w in want} and len(found) == len(want)


@pytest.mark.parametrize("rows", [1, 1 << 20])
def test_best_rows_of_cells_however_they_are_dealt(spark, table, monkeypatch, rows):
    """Against all pairs of a cell, scored component by component; copies tie in the order of their ids."""
    for name, most in {"CELL_ROWS": 1 << 18, "TURN_ROWS": 1 << 19, "SCORES": 900, "EXACT": 7}.items():
        monkeypatch.setattr(retrieval, name, most)
    path, x, _ = table
    v = spark.read.parquet(f"{path}/embeddings.parquet").selectExpr("vec_id", "embedding")
    found = retrieval.best_in_cells(v.filter("vec_id % 20 = 0").selectExpr("*", "explode(array(0, 1)) as cell"), v.selectExpr("*", "cast(vec_id % 3 as int) as cell"), rows, 10)
    assert dict(found.dtypes)["score"] == "double" and "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r.q, []).append((-r.score, r.vec_id))
    for q in range(0, N, 20):
        each = [(-reduce(float.__add__, (x[q] * x[i]).tolist(), 0.0), i) for i in range(N) if i % 3 < 2]
        assert sorted(got[q])[:10] == sorted(each)[:10]
        assert len(got[q]) <= 2 * 10 * max(1, rows >> 18)
