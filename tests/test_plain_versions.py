"""Queries that SQL can't express, each against a plain version on the small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest

from quillwork.functions.encoders import hashed
from quillwork.operators.segmenting import chunk_text, window_ends
from quillwork.plans import registry


@pytest.fixture(scope="module")
def turns(spark, small) -> dict[int, list]:
    out = defaultdict(list)
    for r in spark.read.parquet(f"{small}/conversations.parquet").orderBy("conv_id", "turn").collect():
        out[r.conv_id].append(r)
    return out


@pytest.fixture(scope="module")
def run(spark, small):
    return lambda name: registry.QUERIES[name](spark, small).collect()


def tokens(text: str, least: int = 4) -> list[str]:
    return list(dict.fromkeys(re.findall(f"[a-z0-9]{{{least},}}", text.lower())))


def overlap(a, b) -> float:
    a, b = set(a), set(b)
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def test_seed_clusters(turns, run):
    want = []
    for conv, rows in turns.items():
        seeds = []
        for r in rows:
            mine = tokens(r.text)
            group = next((g for g, role, s in seeds if role == r.role and overlap(mine, s) >= 0.3), r.turn)
            if group == r.turn:
                seeds.append((r.turn, r.role, mine))
            want.append((conv, r.turn, group))
    assert sorted(map(tuple, run("seed_clusters"))) == sorted(want)


def test_merged_commitments(turns, run):
    want = []
    for conv, rows in turns.items():
        records = []
        for r in rows:
            mine = set(tokens(r.text))
            for k in records:
                if overlap(mine, k["tokens"]) >= (0.3 if r.turn - k["last"] <= 2 else 0.6):
                    if len(mine) > len(k["tokens"]):
                        k["survivor"] = r.turn
                    k.update(last=r.turn, tokens=k["tokens"] | mine, members=[*k["members"], r.turn])
                    break
            else:
                records.append({"survivor": r.turn, "last": r.turn, "tokens": mine, "members": [r.turn]})
        want += [(conv, k["survivor"], len(k["members"]), ",".join(map(str, k["members"]))) for k in records]
    assert sorted(map(tuple, run("merged_commitments"))) == sorted(want)


def greedy(pairs: list[tuple]) -> set[tuple]:
    """(score, a, b): best first, each side once."""
    used_a, used_b, out = set(), set(), set()
    for score, a, b in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.add((a, b, score))
    return out


def test_matches_used_once(spark, small, turns, run):
    larger = small.rsplit("/", 1)[0] + "/sf0.01"
    parts = spark.read.parquet(f"{larger}/part.parquet").collect()
    groups = defaultdict(list)
    for r in parts:
        groups[f"{r.p_brand}/{r.p_size}"].append((r.p_partkey, set(re.findall("[a-z0-9]+", r.p_name.lower()) + re.findall("[a-z0-9]+", r.p_type.lower()))))
    want = set()
    for grp, rows in groups.items():
        pairs = [(round(len(s & u) / len(s | u), 6), a, b) for a, s in rows if a % 2 == 0 for b, u in rows if b % 2 and s & u]
        want |= {(grp, *m) for m in greedy([p for p in pairs if p[0] >= 0.38])}
    assert {tuple(r) for r in registry.QUERIES["jaccard_matches_used_once"](spark, larger).collect()} == want and want

    found = defaultdict(list)
    for r in run("one_to_one_turn_matches"):
        found[r.conv_id].append((r.a, r.b, r.score))
    for rows in found.values():  # no pair could be added, and none is beaten by a better one of either side
        assert len({a for a, _, _ in rows}) == len({b for _, b, _ in rows}) == len(rows)


def test_recall_and_precision(turns, run):
    want = []
    for conv, rows in turns.items():
        expected = [(r.turn, tokens(r.text)) for r in rows if r.role == "user"]
        made = [tokens(r.text) for r in rows if r.role != "user"]
        used, hits, repeats = set(), 0, 0
        for m in made:
            best = max(((overlap(m, e), -t) for t, e in expected), default=(0.0, 0))
            if best[0] >= 0.15:
                hits, repeats = hits + (-best[1] not in used), repeats + (-best[1] in used)
                used.add(-best[1])
        want.append((conv, round(hits / len(expected), 4) if expected else 1.0, round(hits / len(made), 4) if made else 1.0, repeats, len(made) - hits - repeats))
    assert sorted(map(tuple, run("recall_and_precision"))) == sorted(want)


def test_segments_follow_valleys_of_cohesion(turns, run):
    found = {(r.conv_id, r.turn): (r.segment, r.cohesion) for r in run("subject_segments")}
    for conv, rows in turns.items():
        bags = [Counter(re.findall("[a-z]{3,}", r.text.lower())) for r in rows]
        cohesion = [1.0]
        for i in range(1, len(bags)):
            a, b = sum(bags[max(0, i - 2) : i], Counter()), sum(bags[i : i + 2], Counter())
            norm = np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
            cohesion.append(sum(a[w] * b[w] for w in a) / norm if norm else 0.0)
        depth = [max(cohesion[:i] or [1.0]) + max(cohesion[i + 1 :] or [1.0]) - 2 * c for i, c in enumerate(cohesion)]
        cut, segment, start = np.mean(depth) + np.std(depth) / 2, 0, 0
        for i, r in enumerate(rows):
            if i - start >= 2 and depth[i] > cut:
                segment, start = segment + 1, i
            assert found[conv, r.turn][0] == segment and abs(found[conv, r.turn][1] - cohesion[i]) < 1e-4


def test_chunks_and_batches_of_turns(turns, run):
    batches = {(r.conv_id, r.turn): r.batch for r in run("packed_batches")}
    chunks = defaultdict(list)
    for r in run("repaired_boundaries"):
        chunks[r.conv_id].append((r.turn, r.chunk))
    for conv, rows in turns.items():
        batch, items, held = 0, 0, 0
        for r in rows:
            if items and (items >= 8 or held + len(r.text) > 2000):
                batch, items, held = batch + 1, 0, 0
            items, held = items + 1, held + len(r.text)
            assert batches[conv, r.turn] == batch
        sizes = list(Counter(c for _, c in sorted(chunks[conv])).values())
        assert sum(sizes) == len(rows) and [c for _, c in sorted(chunks[conv])] == sorted(c for _, c in chunks[conv])
        assert len(sizes) == 1 or min(sizes) >= 2


def test_long_turns_and_documents_lose_no_word(spark, small, turns, run):
    parts = defaultdict(list)
    for r in run("split_long_turns"):
        assert len(r.said) <= 200
        parts[r.conv_id, r.turn].append((r.part, r.said))
    for conv, rows in turns.items():
        for r in rows:
            assert "".join(s for _, s in sorted(parts[conv, r.turn])).replace(" ", "") == "".join(r.text.split())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    found = defaultdict(list)
    for r in run("document_chunks"):
        found[r.doc_id].append((r.chunk, r.said))
    for doc_id, text in texts.items():
        windows = window_ends(text, 1200, 150)
        assert [s for _, s in sorted(found[doc_id], key=lambda c: c[0] or 0) if s is not None] == [x for x in (text[a:b].strip() for a, b in windows) if x]
        assert not text or (windows[0][0], windows[-1][1]) == (0, len(text))
        for (a, b), (c, d) in zip(windows, windows[1:], strict=False):
            assert 660 < b - a <= 1200 and c == b - 150 and d > b


def test_window_ends_prefer_paragraphs_then_sentences():
    text = "a" * 60 + "\n\n" + "b" * 10 + ". " + "c" * 60
    assert window_ends(text, 100, 0)[0] == (0, 60)  # the paragraph, though a sentence ends later
    text = "a" * 30 + "\n\n" + "b" * 40 + ". " + "c" * 60
    assert window_ends(text, 100, 0)[0] == (0, 73)  # the paragraph ends before 55 of 100
    assert window_ends("x" * 250, 100, 10) == [(0, 100), (90, 190), (180, 250)]
    assert chunk_text("   \n ", 100, 0) == [] and chunk_text("", 100, 0) == []


def test_unchanged_lines(spark, small, run):
    found = defaultdict(list)
    for r in run("unchanged_lines"):
        found[r.doc_id].append((r.old_line, r.new_line))
    for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        old = (r.text or "").split("\n")
        new = [x for x in old if not re.search(r"\d", x)] or [""]
        pairs = sorted(found[r.doc_id])
        assert all(old[a] == new[b] for a, b in pairs) and [b for _, b in pairs] == sorted({b for _, b in pairs})
        if new != [""]:  # lines went and none came, so each one of the new version is paired
            assert len(pairs) == sum(m.size for m in SequenceMatcher(None, old, new, autojunk=False).get_matching_blocks())


def test_fuzzy_ratios(spark, small, run):
    parts = defaultdict(list)
    for r in spark.read.parquet(f"{small}/part.parquet").orderBy("p_partkey").collect():
        parts[r.p_brand].append(r)
    want = {}
    for rows in parts.values():
        for x, y in zip(rows, rows[1:], strict=False):
            want[x.p_partkey] = (x.p_name.lower(), y.p_name.lower())
    found = run("fuzzy_ratios")
    assert {r.p_partkey for r in found} == set(want)
    ratio = lambda a, b: 100 * SequenceMatcher(None, a, b, autojunk=False).ratio()
    for r in found:
        a, b = want[r.p_partkey]
        both = " ".join(sorted(set(a.split()) & set(b.split())))
        rest = [(both + " " + " ".join(sorted(set(x.split()) - set(both.split())))).strip() for x in (a, b)]
        assert abs(r.token_set - (max(ratio(both, rest[0]), ratio(both, rest[1]), ratio(*rest)) if both else ratio(*rest))) < 0.01
        short, long = sorted((a, b), key=len)
        windows = [long[i : i + len(short)] for i in range(len(long) - len(short) + 1)]
        best = 100.0 if short in long else max(ratio(short, w) for w in windows) if both else 0.0
        assert abs(r.partial - best) < 0.01


def test_fuzzy_ratios_don_t_depend_on_the_ranges(run, monkeypatch):
    from quillwork.plans import similarity

    want = sorted(map(tuple, run("fuzzy_ratios")))
    monkeypatch.setattr(similarity, "KEY_RANGE", 7)
    assert sorted(map(tuple, run("fuzzy_ratios"))) == want


def test_embedded_texts(spark, small, run):
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    for r in run("embedded_texts"):
        assert r.encoder == "hashed" and np.allclose(r.vector, hashed([texts[r.item_id]], 16)[0])
        assert abs(np.linalg.norm(r.vector) - 1) < 1e-9


def test_clauses_of_turns(turns, run):
    found = defaultdict(list)
    for r in run("status_clauses"):
        found[r.conv_id, r.turn].append((r.clause, r.said))
    for conv, rows in turns.items():
        for r in rows:
            want = [x.strip() for x in re.split(r"\s*[;,]\s*|\s+(?:and|but|while|however)\s+", r.text)] if '"' not in r.text else None
            if want is not None:
                assert [s for _, s in sorted(found[conv, r.turn])] == [x for x in want if x]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_celled_search_at_two_scales(spark, small, sf):
    folder = small.rsplit("/", 1)[0] + f"/{sf}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    ids = np.array([r.vec_id for r in rows])
    found = defaultdict(set)
    for r in registry.QUERIES["celled_search"](spark, folder).collect():
        found[r.q].add(r.vec_id)
    hits, total = 0, 0
    for i in np.flatnonzero(ids % 20 == 0):
        best = set(ids[np.argsort(-(x @ x[i]) / np.linalg.norm(x, axis=1), kind="stable")[:10]].tolist())
        hits, total = hits + len(best & found[int(ids[i])]), total + len(best)
    assert set(found) == set(ids[ids % 20 == 0].tolist()) and hits / total >= 0.9


def test_best_phrases(spark, small):
    folder = small.rsplit("/", 1)[0] + "/sf0.01"
    asked, names = [], defaultdict(set)
    for r in spark.read.parquet(f"{folder}/part.parquet").collect():
        grp, name = (r.p_brand, r.p_size), r.p_name.lower()
        if r.p_partkey % 2:
            names[grp].add(name)
        else:
            asked.append((r.p_partkey, grp, f"{r.p_type[:4]} {r.p_name}".lower()))
    want = {}
    for key, grp, label in asked:
        scores = []
        for name in names[grp]:
            short, long = sorted((label, name), key=len)
            windows = [long[i : i + len(short)] for i in range(len(long) - len(short) + 1)]
            score = 100.0 if name in label else round(max(100 * SequenceMatcher(None, short, w, autojunk=False).ratio() for w in windows), 2) if set(label.split()) & set(name.split()) else 0.0
            scores.append((-score, name))
        if scores and min(scores)[0] <= -85:
            want[key] = (min(scores)[1], -min(scores)[0])
    assert {r.p_partkey: (r.name, r.score) for r in registry.QUERIES["best_phrases"](spark, folder).collect()} == want and want


def test_scored_runs(turns, run):
    found = {r.conv_id: tuple(r)[1:] for r in run("scored_runs")}
    for conv, rows in turns.items():
        said = [(r.turn, r.role, tokens(r.text or "", 3)) for r in rows]
        expected, used = [(t, s) for t, role, s in said if role == "user"], set()
        matched = strict = repeats = noise = 0
        for _, role, s in said:
            if role == "user":
                continue
            ranked = sorted((-overlap(s, e), t) for t, e in expected if t not in used)
            if ranked and ranked[0][0] <= -0.55:
                used.add(ranked[0][1])
                matched, strict = matched + 1, strict + (ranked[0][0] <= -0.70)
            elif any(overlap(s, e) >= 0.55 for _, e in expected):
                repeats += 1
            else:
                noise += 1
        n, m = len(expected), sum(role != "user" for _, role, _ in said)
        assert found[conv] == (round(matched / n, 4) if n else 1.0, round(strict / n, 4) if n else 1.0, round(matched / m, 4) if m else 1.0, repeats, noise)


def test_numeric_facts(spark, small, run):
    from quillwork.functions.phrases import digits_in

    found = {r.doc_id: r.facts for r in run("numeric_facts")}
    for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        want, text = [], digits_in(r.text or "")
        for m in re.finditer(r"[£$€]?[-+]?\d+(?:[.,]\d+)*(?:e[-+]?\d+)?%?", text, re.ASCII):
            want.append(m)
        plain = re.findall(r"(?<![\w.-])([£$€]?[-+]?\d+(?:[.,]\d+)*(?:e[-+]?\d+)?%?)(?![\w-])", text, re.ASCII)
        assert found.get(r.doc_id, []) == list(dict.fromkeys(plain)) and len(plain) <= len(want)


def test_rewritten_phrases(spark, tmp_path):
    said = ["We can't see it, we're late", "They won't and it's ours, our plan", "the 23rd of July on monday", "GBP 5, 7 pounds and 5 to 7 pounds", "we have what we are", "We have it. We go."]
    written = ["The team cannot see it, the team is late", "They will not and it is ours, the team's plan", "23 July on Monday", "£5, £7 and £5 to £7", "the team has what the team is", "The team has it. The team go."]
    rows = spark.createDataFrame([(0, i, "user", t) for i, t in enumerate(said)], "conv_id long, turn long, role string, text string")
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r.s for r in sorted(registry.QUERIES["rewritten_phrases"](spark, str(tmp_path)).collect(), key=lambda r: r.turn)] == written


def test_usefulness_model_learns_words_of_other_sources(spark, tmp_path):
    """Words alone tell good from bad; the texts of held-out sources get the right side of one half."""
    texts = [(i, f"{'clear useful prose' if i % 3 else 'junk spam filler'} number{i % 7}", f"src{i % 20}", int(i % 3 > 0)) for i in range(300)]
    spark.createDataFrame([t[:3] for t in texts], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(t[0], t[3], 0) for t in texts], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = registry.QUERIES["usefulness_model"](spark, str(tmp_path)).collect()
    held = {r.source for r in spark.createDataFrame([(s,) for s in {t[2] for t in texts}], "source string").selectExpr("source", "pmod(xxhash64(source), 4) as k").collect() if r.k == 0}
    assert {r.doc_id for r in found} == {t[0] for t in texts if t[2] in held} and found
    for r in found:
        assert (r.probability > 0.5) == (r.label == 1.0) and r.decision == ("remove" if r.probability <= 0.1 else "keep")
    assert {r.decision for r in found} == {"remove", "keep"}
