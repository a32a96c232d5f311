"""Mergeable clusters: rows as of plain loops, and no task that holds a whole group."""

from __future__ import annotations

import uuid

import numpy as np

from quillwork.operators import summaries
from quillwork.operators.summaries import merged_clusters

LEAST, RANGE, FAN = 0.6, 64, 20


def unit(x):
    return x / max(np.linalg.norm(x), 1e-300)


def gathered(items):
    out = []
    for first, n, v in items:
        scores = np.array([unit(c[2]) for c in out]) @ unit(v) if out else [-1.0]
        best = int(np.argmax(scores))
        if scores[best] >= LEAST:
            f, m, s = out[best]
            out[best] = (min(f, first), m + n, s + v)
        else:
            out.append((first, n, v))
    return out


def plain(x):
    """Cluster of each row of one group, ids from 0 on."""
    parts = {p: gathered([(i, 1, unit(x[i])) for i in range(p * RANGE, min(len(x), (p + 1) * RANGE))]) for p in range(-(-len(x) // RANGE))}
    while len(parts) > 1:
        parts = {u: gathered(sorted((c for p in parts if p // FAN == u for c in parts[p]), key=lambda c: (-c[1], c[0]))) for u in {p // FAN for p in parts}}
    (centres,) = parts.values()
    centres = sorted(centres, key=lambda c: c[0])
    return [centres[int(np.argmax(np.array([unit(c[2]) for c in centres]) @ unit(v)))][0] for v in x]


def made():
    """Vectors around 50 centres, some near and some far from them, and as many around none."""
    rng = np.random.default_rng(11)
    around = rng.normal(size=(50, 24))[rng.integers(0, 50, 600)] + rng.normal(size=(600, 24)) * rng.uniform(0.2, 1.2, (600, 1))
    return rng.permutation(np.concatenate([around, rng.normal(size=(600, 24))]))


def test_clusters_are_those_of_plain_loops_and_no_task_holds_a_group(spark, monkeypatch, tmp_path):
    def noted(real):
        def run(x, *more):
            if x.ndim > 1:
                (tmp_path / uuid.uuid4().hex).write_text(str(len(x)))
            return real(x, *more)

        return run

    for name in ("_gathered", "_unit"):
        monkeypatch.setattr(summaries, name, noted(getattr(summaries, name)))
    monkeypatch.setattr(summaries, "SPAN", 2)
    x = made()
    df = spark.createDataFrame([("all", i, v.tolist()) for i, v in enumerate(x)], "grp string, id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in merged_clusters(df, LEAST, rows_of_range=RANGE, fan=FAN).collect()}
    want = plain(x)
    assert [got[i] for i in range(len(x))] == want
    clusters = len(set(want))
    most = max(int(p.read_text()) for p in tmp_path.iterdir())
    assert 500 < clusters and most < 350  # of 1200 rows


def test_a_vector_without_direction_takes_no_other_row(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [nan, 1.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0]), (5, [0.1, 1.0]), (6, None)]
    df = spark.createDataFrame([("g", i, v) for i, v in rows], "grp string, id long, v array<double>")
    got = sorted(map(tuple, merged_clusters(df, 0.5, rows_of_range=2, fan=2).select("id", "cluster").collect()))
    assert [i for i, _ in got] == [1, 1, 2, 3, 4, 5] and [c for i, c in got if i not in (2, 3)] == [1, 1, 4, 4]
