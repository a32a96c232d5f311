"""Operators 2 and 6 against brute force over all pairs."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.llm import op2_minhash, op6_exact
from quillwork.llm.common import rows_kept, with_groups, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> frozenset:
    words = WORD.findall((text or "").translate(UPPER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_brute(texts: list[str | None]) -> tuple[list[int], list[int]]:
    """Set sizes and the component (least place) of each row, over all pairs."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def check_near(found: list, rows: list[tuple]) -> None:
    sizes, roots = near_brute([r[1] for r in rows])
    ids = defaultdict(list)
    for r, root in zip(rows, roots, strict=True):
        ids[root].append(r[0])
    least = {root: min((i for i in v if i is not None), default=None) for root, v in ids.items()}
    want = sorted((r[0] is None, r[0] or 0, n, least[root] is None, least[root] or 0) for r, n, root in zip(rows, sizes, roots, strict=True))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id is None, r.component_id or 0) for r in found) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert sum(r.kept_row for r in found) == len(ids)  # one row of each component, also where its ids repeat
    assert all(r.kept for r in found if r.kept_row)


def test_components_of_edge_cases(docs, rows):
    check_near(op2_minhash.near_groups(docs).collect(), rows)


def test_components_of_the_small_table(spark, small, sample_rows):
    check_near(op2_minhash.op2_minhash_near_dedup(spark, small).collect(), [(r.doc_id, r.text) for r in sample_rows])


def test_chains_and_pairs_around_the_threshold(spark):
    rng, rows = random.Random(11), []
    for group in range(25):
        words = [f"g{group}v{rng.randrange(10**6)}" for _ in range(rng.choice([6, 20, 60, 200]))]
        for _ in range(rng.choice([2, 5, 9])):
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    rng.shuffle(rows)
    check_near(op2_minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_many_near_copies_of_one_text_share_every_value_list(spark):
    """A boilerplate passage that all texts share must neither link them nor hide the links among them."""
    rng, rows = random.Random(12), []
    passage = " ".join(f"b{i}" for i in range(80))
    for group in range(12):
        own = [f"o{group}x{i}" for i in range(60)]
        for k in range(6):
            own[k] = f"c{group}y{k}"
            rows.append((len(rows), passage + " " + " ".join(own)))
    rng.shuffle(rows)
    check_near(op2_minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_matches_needed_cover_the_threshold():
    rng = np.random.default_rng(0)
    need = op2_minhash.needed(0.75)
    assert (rng.binomial(op2_minhash.COORDINATES, 0.75, 10**6) < need).mean() < 1e-4


def brute_exact(rows: list[tuple]) -> dict:
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    return groups


def test_exact_groups(docs, rows):
    found = op6_exact.exact_groups(docs).collect()
    groups = brute_exact(rows)
    want = []
    for text, members in groups.items():
        keep = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        want += [(str(r[0]), str(keep[0]), len(members), hashlib.sha256(text.encode()).hexdigest()) for r in members]
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == sorted(want)
    assert sum(r.kept for r in found) == len(groups)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_exact_groups_equal_the_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{small}/documents.parquet')")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = con.sql(f"select {','.join(columns)} from ({op6_exact.ORACLE})").fetchall()
    assert sorted(tuple(r) for r in op6_exact.op6_exact_dedup(spark, small).select(columns).collect()) == sorted(want)


def test_clashing_identifiers_fall_back_to_the_strong_hash(docs, monkeypatch):
    """With a fast hash that clashes all the time, results are the same."""
    want = sorted((r.text_sha256, r.group_size) for r in op6_exact.exact_groups(docs).collect())
    real = op6_exact.recipes
    same = F.expr("cast(array_join(transform(strong, c -> '00000000'), '') as binary)")
    monkeypatch.setattr(op6_exact, "recipes", lambda d: real(d).withColumn("fast", same))
    assert sorted((r.text_sha256, r.group_size) for r in op6_exact.exact_groups(docs).collect()) == want


def test_chunks_follow_the_content():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 123, 400_000, dtype=np.uint8).tobytes()
    ends = op6_exact.cuts(data)
    assert ends[-1] == len(data) and all(op6_exact.LEAST < b - a <= op6_exact.MOST for a, b in zip([0, *ends[:-2]], ends[:-1], strict=False))
    chunks = lambda d: {d[a:b] for a, b in itertools.pairwise([0, *op6_exact.cuts(d)])}
    moved = chunks(b"some words before it" + data)
    assert len(moved & chunks(data)) >= len(ends) - 3  # an insertion changes the chunks around it only


@pytest.mark.parametrize(("groups", "by"), [(op6_exact.exact_groups, "kept"), (op2_minhash.near_groups, "kept_row")])
def test_empty_tables_and_rows_kept(docs, empty, groups, by, rows):
    assert groups(empty).collect() == []
    decided = groups(docs)
    kept = rows_kept(docs, decided, by)
    assert kept.columns == docs.columns
    assert kept.count() == decided.filter(by).count()


def test_rows_of_large_groups_join_their_group(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"g{i % 7}", i) for i in range(300)], "row long, g string, is_large long")
    groups = written(rows.groupBy(F.col("g").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).filter("of <> 'g3'"), "groups")
    out = with_groups(rows, "g", groups, "of", "n", "row", large=50)
    assert out.columns == ["row", "g", "is_large", "of", "n", "first"]
    want = rows.join(groups, F.col("g") == F.col("of"), "left")
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
