"""Functions and queries that SQL can't express, against plain versions of the same rules."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillwork.functions import dates, fuzzy, phrases, text
from quillwork.operators import segmenting
from quillwork.plans import registry


def one(spark, column, value, ddl="s string"):
    return spark.createDataFrame([(value,)], ddl).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("said", "number"),
    [("five", 5), ("twenty one", 21), ("twenty-one", 21), ("two hundred and five", 205), ("three thousand", 3000), ("one million two hundred thousand and six", 1_200_006), ("hundred", 100)],
)
def test_numbers_in_words(said, number):
    assert phrases.number_of(said) == number


def test_digits_keep_other_words(spark):
    assert phrases.digits_in("we need twenty-one boxes and one person") == "we need 21 boxes and one person"
    df = spark.createDataFrame([("two hundred",), (None,), ("",)], "s string").select(phrases.digits("s").alias("x"))
    assert [r.x for r in df.collect()] == ["200", None, ""]


@pytest.mark.parametrize(
    ("said", "found"),
    [("paid £5.50 and 7% of 1,000", ["£5.50", "7%", "1,000"]), ("AB-12 x9 9x", []), ("-3 and +4 and -3", ["-3", "+4"]), ("1e5 or 2.5", ["1e5", "2.5"])],
)
def test_quantities_are_not_parts_of_identifiers(spark, said, found):
    assert one(spark, phrases.quantities(F.col("s")), said) == found


@pytest.mark.parametrize(
    ("said", "written"),
    [("I can't go", "I cannot go"), ("they don't know", "they do not know"), ("we've seen it's fine", "we have seen it is fine"), ("cant", "cant")],
)
def test_contractions(spark, said, written):
    assert one(spark, phrases.expand_contractions(F.col("s")), said) == written


@pytest.mark.parametrize(("said", "written"), [("5 pounds", "£5"), ("GBP 1,200", "£1,200"), ("5 to 7 pounds", "£5 to £7"), ("compounds 5", "compounds 5")])
def test_pounds(spark, said, written):
    assert one(spark, phrases.pounds(F.col("s")), said) == written


def test_trailing_question_goes_where_enough_stands_before_it(spark):
    f = phrases.without_trailing_question(F.col("s"))
    assert one(spark, f, "we agreed to send it is that right?") is not None
    assert one(spark, f, "is that right?") is None and one(spark, f, "a plain statement") is None


def test_ranges_of_days(spark):
    start, end = dates.expand_range(F.col("s"), 2024)
    found = spark.createDataFrame([("27 to 7 August",), ("3 - 9 May",), ("no dates",)], "s string").select(start.cast("string").alias("a"), end.cast("string").alias("b")).collect()
    assert [tuple(r) for r in found] == [("2024-07-27", "2024-08-07"), ("2024-05-03", "2024-05-09"), (None, None)]


def osa_plain(a: str, b: str) -> int:
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_transposition_distance(a, b):
    assert fuzzy.osa(a, b) == osa_plain(a, b)


def test_a_substring_is_edited_once():
    assert fuzzy.osa("ca", "abc") == 3 and fuzzy.osa("ab", "ba") == 1


@settings(max_examples=100, deadline=None)
@given(st.text("ab ", max_size=12), st.text("ab ", max_size=12))
def test_ratios(a, b):
    assert fuzzy.ratio(a, b) == 100 * SequenceMatcher(None, a, b, autojunk=False).ratio()
    assert 0 <= fuzzy.token_set(a, b) <= 100
    assert fuzzy.partial(a, a) == 100


@settings(max_examples=200, deadline=None)
@given(st.text("ab .!?\n", max_size=300), st.integers(5, 40))
def test_long_texts_are_split_within_the_bound(s, most):
    parts = segmenting.split_text(s, most)
    assert all(0 < len(p) <= most for p in parts)
    assert "".join("".join(parts).split()) == "".join(s.split())


@settings(max_examples=200, deadline=None)
@given(st.text("abc. \n", max_size=400), st.integers(20, 60))
def test_chunks_cover_a_text_in_order(s, size):
    parts = segmenting.chunk_text(s, size, size // 8)
    at = 0
    for p in parts:
        assert 0 < len(p) <= size
        found = s.find(p, max(0, at - size))
        assert found >= 0
        at = found + len(p)
    assert set("".join(s.split())) <= set("".join(parts))


def test_clauses_leave_quotes_whole():
    assert segmenting.split_clauses('we ship, "a, b and c" stays; then we rest and sleep') == ["we ship", '"a, b and c" stays', "then we rest", "sleep"]
    assert segmenting.split_clauses("") == []


def test_stems(spark):
    words = {"working": "work", "worked": "work", "boxes": "box", "cats": "cat", "is": "is", "bed": "bed"}
    df = spark.createDataFrame([(w,) for w in words], "s string").select("s", text.stem(F.col("s")).alias("x"))
    assert {r.s: r.x for r in df.collect()} == words


def test_greedy_matches_use_each_side_once(spark, small):
    rows = registry.QUERIES["one_to_one_turn_matches"](spark, small).collect()
    assert rows
    for conv in {r.conv_id for r in rows}:
        mine = [r for r in rows if r.conv_id == conv]
        assert len({r.a for r in mine}) == len(mine) == len({r.b for r in mine})


def test_celled_search_finds_most_true_neighbours(spark, small):
    import numpy as np

    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = {r.vec_id: np.array(r.embedding, float) for r in rows}
    ids, m = list(x), np.array(list(x.values()))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    found: dict[int, set] = {}
    for r in registry.QUERIES["celled_search"](spark, small).collect():
        found.setdefault(r.q, set()).add(r.vec_id)
    hits = 0
    asked = [i for i in ids if i % 20 == 0]
    for q in asked:
        best = np.argsort(-(m @ m[ids.index(q)]), kind="stable")[:10]
        hits += len({ids[i] for i in best} & found[q])
    assert hits / (10 * len(asked)) >= 0.9


def covers(rows, key: str) -> None:
    """Consecutive parts of each conversation, numbered from 0 without a gap."""
    by = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append(r[key])
    for parts in by.values():
        assert parts[0] == 0 and all(b - a in (0, 1) for a, b in zip(parts, parts[1:], strict=False))


@pytest.mark.parametrize(("name", "key"), [("repaired_boundaries", "chunk"), ("packed_batches", "batch"), ("subject_segments", "segment")])
def test_parts_of_conversations(spark, small, name, key):
    rows = registry.QUERIES[name](spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/conversations.parquet").count()
    covers(rows, key)


def test_batches_keep_both_bounds(spark):
    rng = random.Random(1)
    turns = [(1, i, rng.randrange(1, 900)) for i in range(200)]
    rows = segmenting.batch_in_order(spark.createDataFrame(turns, "conv_id long, turn long, size long"), 8, 2000).collect()
    size = {t: s for _, t, s in turns}
    batches: dict[int, list] = {}
    for r in rows:
        batches.setdefault(r.batch, []).append(size[r.turn])
    assert all(len(b) <= 8 and (sum(b) <= 2000 or len(b) == 1) for b in batches.values())
    # No batch could have taken the next turn.
    for k in range(len(batches) - 1):
        assert len(batches[k]) == 8 or sum(batches[k]) + batches[k + 1][0] > 2000


def test_usefulness_probabilities(spark, small):
    rows = registry.QUERIES["usefulness_model"](spark, small).collect()
    assert rows and all(0 <= r[c] <= 1 for r in rows for c in r.asDict() if c.startswith("prob"))


def test_recall_and_precision_are_shares(spark, small):
    for r in registry.QUERIES["recall_and_precision"](spark, small).collect():
        assert 0 <= r.recall <= 1 and 0 <= r.precision <= 1
