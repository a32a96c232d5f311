"""Operators 11 to 13 against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from quillwork.llm import op11_middle, op12_suffixes, op13_centroids
from quillwork.llm.queries import ORACLE_SQL, QUERIES


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


# Operator 11


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text.encode()), sha(text.encode()))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out.encode()), sha(text.encode()))


def digests(df):
    from pyspark.sql import functions as F

    out = df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256), F.sha2(op11_middle.restored().cast("binary"), 256))
    return Counter(map(tuple, out.collect()))


def test_middle_equals_a_plain_version(spark, docs, rows, empty):
    assert digests(op11_middle.transformed(docs)) == Counter(plain_middle(r[0], r[1]) for r in rows)
    assert op11_middle.transformed(empty).count() == 0


def test_middle_of_texts_with_markers_seams_and_long_runs(spark):
    rng = random.Random(3)
    parts = ["<", "P>", "S>", "M>", "<P>", "<S", "a", "Z", "é", "日本", "🙂", " ", "\n", "abc"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(400)]
    texts += ["x" * (op11_middle.CHUNK * 3), "é" * op11_middle.CHUNK + "ab" * op11_middle.CHUNK, "a " * (op11_middle.STRIP // 2 + 5), "", None]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(op11_middle.transformed(df)) == Counter(plain_middle(*r) for r in rows)


def test_counts_of_chunks_and_places_of_every_rank():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab é🙂.\n") for _ in range(rng.randrange(0, 40))) for _ in range(30)]
    chunk, strip = op11_middle.CHUNK, op11_middle.STRIP
    op11_middle.CHUNK, op11_middle.STRIP = 5, 17  # many chunks and strips of them
    try:
        units = op11_middle.Units([t.encode() for t in texts])
        for i, t in enumerate(texts):
            found = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
            assert units.count(i) == len(found)
            for rank in range(len(found) + 1):
                before = "".join(found[:rank])
                assert units.place(i, rank) == (len(before.encode()), len(before))
    finally:
        op11_middle.CHUNK, op11_middle.STRIP = chunk, strip


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_centroid_clusters"])
def test_query_equals_its_sql(spark, small, name):
    df = QUERIES[name](spark, small)
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    want = con.sql("select " + ", ".join(sorted(df.columns)) + f" from ({ORACLE_SQL[name]}) as q").fetchall()
    assert Counter(map(tuple, df.select(*sorted(df.columns)).collect())) == Counter(want)


# Operator 12


def plain_dedup(texts: list[str | None], window: int) -> list[tuple]:
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = True
        runs = int(np.count_nonzero(gone[1:] > gone[:-1])) + bool(gone[0])
        out.append((len(r), int(gone.sum()), runs, sha(bytes(b for b, g in zip(r, gone[:-1], strict=True) if not g))))
    return out


def dedup(docs, **options) -> Counter:
    spans = op12_suffixes.repeated_spans(docs, **options)
    kept = {bytes(r["key"]): bytes(r["kept"]) for r in op12_suffixes.kept_bytes(docs, spans).collect()}
    out = Counter()
    for r in spans.collect():
        key = bytes(r["key"])
        digest = key.hex() if not r["n_removed"] else sha(b"") if r["n_removed"] == r["n_bytes"] else sha(kept[key])
        out[(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]) // 2, digest)] += 1
    return out


def test_dedup_of_edge_cases_equals_brute_force(spark, docs, rows, empty):
    want = Counter((r[0], *x) for r, x in zip(rows, plain_dedup([r[1] for r in rows], 400), strict=True))
    assert dedup(docs) == want
    # Small blocks and buckets give the same.
    assert dedup(docs, bucket=300, block=20_000) == want
    assert op12_suffixes.repeated_spans(empty).count() == 0


def test_the_query_gives_the_digests(spark, small, sample_rows):
    want = Counter((r["doc_id"], *x) for r, x in zip(sample_rows, plain_dedup([r["text"] for r in sample_rows], 400), strict=True))
    got = op12_suffixes.op12_suffix_dedup(spark, small)
    assert Counter(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == want
    assert sum(x[2] > 0 for x in want) > 5 and any(0 < x[2] < x[1] for x in want)


@pytest.mark.parametrize("window", [20, 40, 61])
def test_dedup_of_repeats_at_every_shift(spark, window):
    """Passages of one less than, exactly and more than the window, at all shifts, overlapping and periodic ones."""
    rng = random.Random(window)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passages = [word(window + d) for d in (-1, 0, 1, 7, 30, 3 * window)]
    texts = []
    for i in range(150):
        t = word(rng.randrange(0, 3 * window))
        for p in rng.sample(passages, rng.randrange(0, 3)):
            t = t[: rng.randrange(len(t) + 1)] + p + word(rng.randrange(0, window))
        texts.append(t)
    texts += ["ab" * window, "a" * (window + 3), "a" * window, "a" * window, "é" * window, word(window - 1) * 2, None, "", texts[0], texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = Counter((i, *x) for i, x in enumerate(plain_dedup(texts, window)))
    assert dedup(df, window=window) == want
    assert dedup(df, window=window, bucket=64, block=500) == want


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11, 13])
def test_every_difference_is_in_the_cover(q):
    v, found = op12_suffixes.difference_cover(q)
    assert v == q * q + q + 1 and Counter((a - b) % v for a in found for b in found if a != b) == Counter(range(1, v))


def test_a_passage_of_most_documents_is_one_entry_of_a_block():
    prints = np.array([5] * 1000 + [7, 9], np.uint64) << np.uint64(40)
    out = op12_suffixes.sent(3, prints, b"note", 0, "<u8").to_pylist()
    assert len(np.frombuffer(out[0]["alone"], "<u8")) == 2 and len(np.frombuffer(out[0]["several"], "<u8")) == 1


# Operator 13


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    names = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)
    centroids = [q for _, q in names[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *near(q)[::-1]) for i, q in kept]
    most = (1 << 63) - 1
    part = Counter()
    for _, j, d in found:
        part[j] += min(d, most)
    whole = sum(part.values())
    return Counter((i, j, min(d, most), min(part[j], most), min(whole, most), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in found)


EMBEDDINGS = "vec_id long, embedding array<float>, label int, cluster int, q string"


def clusters_of(spark, folder, rows):
    spark.createDataFrame([(i, e, 0, 1, "x") for i, e in rows], EMBEDDINGS).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    df = op13_centroids.op13_centroid_clusters(spark, str(folder))
    return Counter(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()))


def test_clusters_equal_plain_ones(spark, small, tmp_path):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    vector = lambda *x: [float(v) for v in (*x, *[0.0] * (64 - len(x)))]
    odd = [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [None] + [1.0] * 63), (1004, [math.nan] + [1.0] * 63), (1005, [math.inf] + [1.0] * 63), (None, vector(1)), (1006, vector(-0.0003)), (1006, vector(-0.0003)), (1007, vector(*[-1.0] * 64))]
    assert clusters_of(spark, tmp_path / "a", rows + odd) == plain_clusters(rows + odd)


def test_ties_few_vectors_and_large_components(spark, tmp_path):
    grid = [(i, [float(x), float(y), *[0.0] * 62]) for i, (x, y) in enumerate((x, y) for x in (-1, 0, 1) for y in (-1, 0, 1))]
    for name, rows in {
        "ties": grid * 3,  # equal distances to several centroids, and centroids that are equal
        "few": grid[:3],
        "one": grid[:1] * 5,
        "large": grid + [(100, [3e38] + [0.0] * 63), (101, [-3e38] + [1.0] * 63), (102, [1e6] * 64)],
    }.items():
        assert clusters_of(spark, tmp_path / name, rows) == plain_clusters(rows), name
    assert clusters_of(spark, tmp_path / "none", []) == Counter()


def test_the_annulus_leaves_out_only_what_is_farther():
    rng = np.random.default_rng(4)
    centroids = [tuple(c) for c in (rng.integers(-300, 300, (200, 16)) * rng.integers(1, 60, (200, 1))).tolist()]
    centroids += centroids[:5] + [(0,) * 16]
    # Vectors near one centroid have small bounds; those between two have ties.
    q = np.concatenate([np.array(centroids)[rng.integers(0, 200, 800)] + rng.integers(-40, 40, (800, 16)), np.zeros((1, 16), np.int64), np.array(centroids)])
    search = op13_centroids.Annuli(centroids)
    number, best = search.nearest(q)
    every = ((q[:, None, :] - np.array(centroids)[None]) ** 2).sum(axis=2)
    assert (best == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()
    assert search.compared < 0.3 * every.size
