"""Operators that keep their results at any skew: bounded candidates, ranks by depth, one-to-one matches."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillwork.functions.text import words
from quillwork.operators import ranks
from quillwork.operators.candidates import best_sharing
from quillwork.operators.matching import greedy_pairs


def plain_best(items, rows, k, newest=False):
    out = set()
    for i, own in items.items():
        scored = sorted((-len(own & w), -r if newest else r, r) for r, w in rows.items() if own & w)[:k]
        out |= {(i, r, -s, n + 1) for n, (s, _, r) in enumerate(scored)}
    return out


@pytest.mark.parametrize(("k", "newest"), [(1, False), (3, True), (40, False)])
def test_best_candidates_equal_all_pairs(spark, k, newest):
    rng = random.Random(k)
    # Common words in most rows, rare ones in few; items without any known word, with one, and with copies.
    draw = lambda n: {f"w{min(int(rng.paretovariate(0.7)), 900)}" for _ in range(n)}
    rows = {i: draw(rng.randrange(1, 40)) for i in range(300)}
    items = {i: draw(rng.randrange(1, 25)) for i in range(60)} | {100: {"none"}, 101: {"w1"}, 102: {"w1", "w2", "w3"}, 103: rows[7] | {"none"}, 104: rows[7]}
    a = spark.createDataFrame([(i, sorted(w)) for i, w in items.items()], "item long, words array<string>")
    b = spark.createDataFrame([(i, sorted(w)) for i, w in rows.items()], "row long, words array<string>")
    best, pairs = best_sharing(a, b, k, F.desc("row") if newest else None)
    assert set(map(tuple, best.collect())) == plain_best(items, rows, k, newest)
    assert pairs.count() == pairs.distinct().count()


def test_few_pairs_are_counted_for_passages_that_documents_hold(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    tokens = F.array_distinct(words(F.col("text"), 4))
    rows = docs.select(F.col("doc_id").alias("row"), tokens.alias("words"))
    # A passage of every fifth document, thirty words long.
    part = F.slice(F.split("text", " "), 20, 30)
    items = docs.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("item"), F.array_distinct(words(F.array_join(part, " "), 4)).alias("words")).filter("size(words) > 9")
    best, pairs = best_sharing(items, rows)
    assert best.filter("shared > 9").count() == items.count()
    assert pairs.count() < 0.1 * items.count() * docs.count()


def nearest(values, q):
    s = sorted(values)
    return s[max(1, -(-int(q * 1000) * len(s) // 1000)) - 1]


@pytest.mark.parametrize("kind", ["double", "long", "decimal(18,2)"])
def test_ranks_of_heavy_tails_sort_few_rows(spark, kind):
    rng = random.Random(1)
    groups = {
        "tail": [rng.paretovariate(0.3) for _ in range(3000)] + [1e15],
        "signs": [rng.gauss(0, 1) ** 7 * 1000 for _ in range(3000)],
        "near": [1e9 + rng.random() for _ in range(2000)] + [-1e15, 1e15],
        "same": [5.0] * 4000,
        "few": [3.0, 1.0, 2.0],
        None: [float(i % 7) for i in range(900)],
    }
    cast = {"double": float, "long": int, "decimal(18,2)": lambda v: round(float(v), 2)}[kind]
    data = [(k, cast(v)) for k, vs in groups.items() for v in vs]
    rng.shuffle(data)
    df = spark.createDataFrame([(k, float(v)) for k, v in data] + [("few", None)], "k string, x double").select("k", F.col("x").cast(kind).alias("v"))
    want = defaultdict(list)
    for k, v in data:
        want[k].append(v)
    found, ranges, rounds = ranks._ranges(df, ["k"], "v", {"p50": ranks.nearest_rank(0.5), "p95": ranks.nearest_rank(0.95), "top": F.col("n")}, 100)
    got = {r["k"]: (r["p50"], r["p95"], r["top"]) for r in found.collect()}
    for k, vs in want.items():
        assert tuple(map(float, got[k])) == tuple(map(float, (nearest(vs, 0.5), nearest(vs, 0.95), max(vs)))), k
    # What is sorted is bounded, but where a range is one value.
    assert ranges.filter("c > 100 and low < high").isEmpty() and 0 < rounds <= 7


def plain_greedy(edges):
    taken, used_a, used_b = set(), set(), set()
    for g, a, b, score in sorted(edges, key=lambda e: (-e[3], e[1], e[2])):
        if (g, a) not in used_a and (g, b) not in used_b:
            used_a.add((g, a))
            used_b.add((g, b))
            taken.add((g, a, b, score))
    return taken


def test_mutually_best_pairs_are_the_greedy_choice(spark):
    rng = random.Random(6)
    edges = {(g, a, b): rng.choice([0.2, 0.5, 0.5, 0.9, rng.random()]) for g in range(3) for a in range(25) for b in range(25) if rng.random() < 0.3}
    edges |= {(9, i, i + d): 1.0 - (2 * i + d) / 50 for i in range(12) for d in (0, 1)}  # a chain
    edges |= {(8, 1, b): 0.5 for b in range(200)}  # a hot side
    rows = [(*k, s) for k, s in edges.items()]
    got = greedy_pairs(spark.createDataFrame(rows, "grp long, a long, b long, score double"), "grp")
    assert Counter(map(tuple, got.collect())) == Counter(plain_greedy(rows))
    assert greedy_pairs(spark.createDataFrame([], "grp long, a long, b long, score double"), "grp").count() == 0
