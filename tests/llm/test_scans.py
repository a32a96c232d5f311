"""Operators 5, 7, 8 and 9 against brute force and held-out labels."""

from __future__ import annotations

import hashlib
import math
import time
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm import bpe, lattice, op5_secrets, op7_langid, op8_quality, op9_lm, textscan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PIECES = bpe.vocabulary("piece_bpe_32k.model")


# -- operator 5 ----------------------------------------------------------------------------------


def base_spans(text: str) -> list[tuple]:
    """Either case of the letters a-z and A-Z: the long s and the Kelvin sign are other characters."""
    kinds = {
        "assign": [m for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12],
        "access": [m for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18],
        "hex": [m for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16],
    }
    return sorted((m.start(), list(kinds).index(k), k, m.end()) for k, ms in kinds.items() for m in ms)


def expected_secrets(text: str | None) -> tuple:
    spans = base_spans(text or "")
    n = Counter(k for _, _, k, _ in spans)
    said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(said.encode()).hexdigest()


def reported(docs, folder) -> DataFrame:
    paths = op5_secrets.extend_ledger(docs, folder)
    return op5_secrets.report(op5_secrets.findings(paths, op5_secrets.read_ledger(docs.sparkSession, folder)))


def test_secrets_of_edge_cases_and_the_small_table(spark, docs, rows, small, sample_rows, empty, tmp_path):
    columns = ["n_assign", "n_access", "n_hex", "base_sha256"]
    assert reported(empty, f"file://{tmp_path}/none").collect() == []
    found = reported(docs, f"file://{tmp_path}/ledger")
    assert sorted(tuple(r) for r in found.select(columns).collect()) == sorted(expected_secrets(r[1]) for r in rows)
    got = op5_secrets.op5_secret_scan(spark, small).collect()
    assert {r.doc_id: tuple(r[c] for c in columns) for r in got} == {r.doc_id: expected_secrets(r.text) for r in sample_rows}
    for r in got:
        base = [s for s in r.spans.split(",") if s.split(":")[0] in op5_secrets.BASE]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
        starts = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert starts == sorted(starts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "TOKEN", "api_key", "apikey", "=", ": ", "'", '"', "abcdef012345", "AKIA", "ABCD1234EFGH5678", " ", "\n", "é", "ſecret", "to\u212aen", "toKen", "."]), max_size=14).map("".join))
@example("ſecret=tokentokentoken")
@example("to\u212aen=tokentokentoken")
@example("api_\u212aey: tokentokentoken ToKeN='tokentokentoken")
def test_base_rules_on_any_text(text):
    spans = sorted((a, i, r.kind, b) for i, r in enumerate(op5_secrets.RULES[:3]) for a, b in op5_secrets.scanner(r)(text, text.lower()))
    assert spans == base_spans(text)


def test_the_ledger_scans_unseen_pairs_only(spark, tmp_path):
    folder, rules = f"file://{tmp_path}/ledger", len(op5_secrets.RULES)
    ledger = lambda: op5_secrets.read_ledger(spark, folder)
    first = spark.createDataFrame([(1, "token=abcdefghijkl"), (2, "plain"), (3, "token=abcdefghijkl")], "doc_id long, text string")
    op5_secrets.extend_ledger(first, folder)
    assert ledger().count() == 2 * rules  # two blobs
    op5_secrets.extend_ledger(first, folder)
    assert ledger().count() == 2 * rules  # nothing new
    more = first.union(spark.createDataFrame([(4, "0123456789abcdef")], "doc_id long, text string"))
    op5_secrets.extend_ledger(more, folder)
    assert ledger().count() == 3 * rules and ledger().select("blob").distinct().count() == 3
    raised = tuple(op5_secrets.Rule(r.kind, 2 if r.kind == "hex" else r.version, r.pattern, r.hints, r.flags, r.group, r.least) for r in op5_secrets.RULES)
    paths = op5_secrets.extend_ledger(more, folder, raised)
    assert [(r.kind, r.n) for r in ledger().filter("version = 2").groupBy("kind").agg(F.count("*").alias("n")).collect()] == [("hex", 3)]
    assert ledger().count() == 3 * rules + 3
    found = op5_secrets.report(op5_secrets.findings(paths, ledger(), raised))
    assert {r.doc_id: r.spans for r in found.collect()} == {1: "assign:0:18", 2: "", 3: "assign:0:18", 4: "hex:0:16"}


@pytest.mark.parametrize("rule", op5_secrets.RULES, ids=lambda r: r.kind)
@pytest.mark.parametrize("part", ["eyJ", "eyJhbGciOiJI.", "eyJabcdefgh.abcdefg.", "-----BEGIN ", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN A", "password ", "token= ", "secret", "api_key='", "AKIA", "AKIA0", "0a", "0", "ghp_", "ghpgho_a", "gho_" + "a" * 35 + "_", "."])
def test_a_megabyte_that_nearly_matches_takes_below_a_second(rule, part):
    text = part * (1_000_000 // len(part))
    began = time.process_time()
    op5_secrets.scanner(rule)(text, text.lower())
    assert time.process_time() - began < 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["eyJ", "e", "yJ", "abcdefgh", "a", "-_", ".", "..", " ", "é", "12345678", "\n"]), max_size=16).map("".join))
@example("eyJeyJabcdefgh.abcdefgh.abcdefgh.eyJabcdefgh.abcdefgh.abcdefgh")
@example("eyJa.eyJabcdefgh.abcdefgh.abcdefgh")
def test_web_tokens_equal_the_plain_pattern(text):
    plain = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    jwt = next(r for r in op5_secrets.RULES if r.kind == "jwt")
    assert op5_secrets.scanner(jwt)(text, text.lower()) == [m.span() for m in plain.finditer(text)]


def test_a_small_increment_leaves_most_texts_where_they_are(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    op5_secrets.extend_ledger(docs, folder)
    before = op5_secrets.read_ledger(spark, folder).count()
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(9001, "token=abcdefghijkl")], "doc_id long, text string"))
    paths = op5_secrets.extend_ledger(more, folder)
    assert op5_secrets.read_ledger(spark, folder).count() == before + len(op5_secrets.RULES)
    assert paths.count() == more.count()


def test_the_querys_second_increment_scans_what_the_first_lacks(spark, docs, rows, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    blobs, total = set(), 0
    for k in (0, 1):
        part = docs.filter(half == k)
        op5_secrets.extend_ledger(part, folder)
        now = {hashlib.sha256((r.text or "").encode()).hexdigest() for r in part.select("text").collect()}
        total += len(op5_secrets.RULES) * len(now - blobs)
        assert now & blobs or not blobs  # some texts of the second increment are old
        blobs |= now
        assert op5_secrets.read_ledger(spark, folder).count() == total


def test_redaction():
    text = "é token=abcdefghijkl and AKIAABCDEFGHIJKLMN."
    spans = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base_spans(text))
    assert op5_secrets.redact(text, spans) == "é [assign] and [access]."
    assert op5_secrets.redact("abcdef", "a:1:4,b:2:3,c:3:5") == "a[a]f"


@pytest.mark.parametrize("most_bytes", [32 << 20, 0])
def test_redacted_keeps_every_row_and_column(docs, rows, most_bytes, tmp_path):
    out = op5_secrets.redacted(docs, reported(docs, f"file://{tmp_path}/ledger"), most_bytes)
    found = out.collect()
    assert out.columns == docs.columns and len(found) == len(rows)
    assert sorted(r.text for r in found if r.text and not base_spans(r.text) and "[" not in r.text) == sorted(r[1] for r in rows if r[1] and not base_spans(r[1]) and "PRIVATE" not in r[1])
    assert not any(base_spans(r.text or "") for r in found)
    assert all(r.n_chars == len(r.text) for r in found if r.text is not None)


# -- operator 7 ----------------------------------------------------------------------------------


def test_languages_of_held_out_texts(spark, small):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang").collect()}
    found = op7_langid.op7_language_id(spark, small).collect()
    assert {r.doc_id for r in found} == set(truth)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    held = [r for r in found if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_language_of_edge_cases(docs, rows, empty):
    model = op7_langid.train(docs, ~op7_langid.held_out())
    found = op7_langid.predict(docs, model).collect()
    assert len(found) == len(rows)
    no_letter = lambda t: not t or not any(c.isalpha() for c in t)
    assert sorted(str(r.doc_id) for r in found if r.lang_pred == "und") == sorted(str(r[0]) for r in rows if no_letter(r[1]))
    assert all(r.score == 0 for r in found if r.lang_pred == "und")
    kept = op7_langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not no_letter(r[1]) for r in rows)
    assert op7_langid.predict(empty, op7_langid.train(empty, F.lit(True))).collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    untaught = op7_langid.train(unlabelled, F.lit(True))
    assert {r.lang_pred for r in op7_langid.predict(docs, untaught).collect()} == {"und"}
    assert op7_langid.accepted(docs, untaught).count() == kept.count()


PROSE = {
    "en": ["the river and the stone are in the valley of the old king", "where is the house that they built on the hill", "she said that nothing of the kind was there"],
    "de": ["der fluss und der stein sind im tal des alten königs", "wo ist das haus das sie auf dem hügel bauten", "sie sagte dass nichts dergleichen da war"],
    "fr": ["la rivière et la pierre sont dans la vallée du vieux roi", "où est la maison qu'ils ont bâtie sur la colline", "elle a dit que rien de tel n'était là"],
    "it": ["il fiume e la pietra sono nella valle del vecchio re", "dove si trova la casa che hanno costruito sulla collina", "disse che non c'era niente di simile"],
    "fi": ["joki ja kivi ovat vanhan kuninkaan laaksossa", "missä on talo jonka he rakensivat mäelle", "hän sanoi ettei mitään sellaista ollut"],
    "pl": ["rzeka i kamień są w dolinie starego króla", "gdzie jest dom który zbudowali na wzgórzu", "powiedziała że niczego takiego tam nie było"],
}


def plain_trigrams(text: str) -> dict[int, float]:
    """Damped counts of hashed trigrams, character by character."""
    data = []
    for b in f" {text} ".encode():
        c = b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
        if not (c == 0x20 and data and data[-1] == 0x20):
            data.append(c)
    counts = Counter(((x << 16 | y << 8 | z) * 0x9E3779B1 % (1 << 32)) >> 19 for x, y, z in zip(data, data[1:], data[2:], strict=False))
    return {k: math.sqrt(c / counts.total()) for k, c in counts.items()}


def dot(u: dict, v: dict) -> float:
    return sum(a * v[k] for k, a in u.items() if k in v)


@pytest.mark.parametrize("langs", [["en"], ["en", "de"], ["en", "de", "fr"], list(PROSE)])
def test_bits_losses_and_flags_against_plain_loops(langs):
    rows = [(lang, t) for lang in langs for t in PROSE[lang]]
    model = op7_langid.fit([(lang, op7_langid.features(t), True) for lang, t in rows])
    names = sorted(langs)
    code, x = model.code.tolist(), [plain_trigrams(t) for _, t in rows]
    n, bits = len(rows), len(code[0])
    target = [[code[names.index(lang)][k] for k in range(bits)] for lang, _ in rows]
    centre = [sum(t[k] for t in target) / n for k in range(bits)]
    gram = np.array([[dot(u, v) + (op7_langid.RIDGE * n if i == j else 0) for j, v in enumerate(x)] for i, u in enumerate(x)])
    alpha = np.linalg.solve(gram, np.array(target) - np.array(centre))
    kernel = lambda t: [dot(plain_trigrams(t), u) for u in x]
    bit = lambda t: [centre[k] + sum(s * alpha[i][k] for i, s in enumerate(kernel(t))) for k in range(bits)]
    right = [sum((f[k] > 0) == (y[k] > 0) for f, y in zip(map(bit, (t for _, t in rows)), target, strict=True)) / n for k in range(bits)]
    trust = [max(0.05, math.log((r + 0.01) / (1.01 - r))) for r in right]
    loss = lambda f: [sum(w / sum(trust) * math.exp(-min(8, max(-8, 2 * c * v))) for w, c, v in zip(trust, word, f, strict=True)) for word in code]
    nearest = []
    for i in range(n):  # each text left out of the fit, which is then done anew
        rest = [j for j in range(n) if j != i]
        a = np.linalg.solve(gram[np.ix_(rest, rest)], (np.array(target) - np.array(centre))[rest])
        k = [gram[i][j] for j in rest]
        nearest.append(min(loss([centre[b] + sum(s * a[m][b] for m, s in enumerate(k)) for b in range(bits)])))
    far = max(0.93 * min(loss(centre)), np.mean(nearest) + 6 * np.std(nearest))
    assert math.isclose(model.far, far, rel_tol=1e-3)
    for text in ["the old house on the hill", "das alte haus", "où est le roi", "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx", "Avec.", *(t for _, t in rows)]:
        f = bit(text)
        losses = loss(f)
        assert np.allclose(model.losses(text), losses, rtol=1e-3, atol=1e-4)
        ordered = sorted(range(len(names)), key=lambda i: losses[i])
        lang, score, ambiguous, none = model.judge(text)
        assert lang == names[ordered[0]] and math.isclose(score, 1 / sum(math.exp(-4 * (v - losses[ordered[0]])) for v in losses), rel_tol=1e-2)
        close = len(names) > 1 and losses[ordered[1]] - losses[ordered[0]] < op7_langid.AMBIGUOUS
        assert ambiguous == close
        assert none == (losses[ordered[0]] > far and sum(map(str.isalpha, text)) >= 20)


def test_junk_is_in_no_language_and_short_texts_stay(spark):
    rng = np.random.default_rng(4)
    mixed = [(lang, " ".join(rng.choice(" ".join(PROSE[lang]).split(), 14))) for lang in PROSE for _ in range(20)]
    rows = [(200 + i, t, lang) for i, (lang, t) in enumerate(mixed)] + [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang in PROSE for t in PROSE[lang])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op7_langid.train(docs, F.lit(True))
    assert model.langs == sorted(PROSE)  # six languages, so the codewords are random ones
    more = docs.union(spark.createDataFrame([(100, "zzqqxxjj" * 40, None), (101, "zq", None), (102, "12 + 3", None)], docs.schema))
    kept = {r.doc_id for r in op7_langid.accepted(more, model).collect()}
    assert kept == {r[0] for r in rows} | {101}
    assert not any(model.judge(t)[2] for _, t, _ in rows)
    for bias, ambiguous in ((0.0, True), (0.01, True), (-0.02, False), (1.0, False)):
        weights = np.zeros((op7_langid.DIMS + 1, 1), np.float32)
        weights[-1] = bias
        flagged = op7_langid.Model(["a", "b"], np.array([[1.0], [-1.0]]), weights, np.ones(1)).judge("word")
        assert flagged[0] == ("b" if bias < 0 else "a") and flagged[2] == ambiguous


@pytest.mark.parametrize("n", [2, 3, 5, 8, 20])
def test_codewords_are_far_apart(n):
    code = op7_langid.codewords(n)
    gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(gaps) >= max(1, code.shape[1] // 4) and all(len(set(c)) == 2 for c in code.T)


# -- operator 8 ----------------------------------------------------------------------------------


def expected_quality(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            inside.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


def test_quality_counts(spark, docs, rows, small, sample_rows, empty):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = op8_quality.quality(docs).collect()
    assert sorted(tuple(r[c] for c in columns) for r in found) == sorted(expected_quality(r[1]) for r in rows)
    got = op8_quality.op8_quality_rules(spark, small).collect()
    assert {r.doc_id: tuple(r[c] for c in columns) for r in got} == {r.doc_id: expected_quality(r.text) for r in sample_rows}
    for r in [*found, *got]:
        assert not (r.base_failed and r.kept)
        assert r.kept == (not r.base_failed and not r.failed_rules)
    assert op8_quality.quality(empty).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b ", "c\n", " ", "\n", "#", "é", " ", "\x0b", "a b a b a b a b a b a b "]), max_size=30).map("".join), min_size=1, max_size=4))
def test_measures_of_any_texts(texts):
    found = op8_quality.measure_texts(texts)
    want = [expected_quality(t) for t in texts]
    assert [tuple(found[c][i] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for i in range(len(texts))] == [w[:5] for w in want]


def test_sketches_merge_and_are_near_true_quantiles(spark):
    rng = np.random.default_rng(2)
    values = np.round(rng.lognormal(1, 0.5, 4000)).astype(int) + 1
    measured = spark.createDataFrame([("en", f"s{i % 3}", 1000, 5000, 0, 0, int(v), 10) for i, v in enumerate(values)], "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    parts = [op8_quality.sketches(measured.filter(f"source {how} 's1'")) for how in ("=", "<>")]
    for sketch in (op8_quality.sketches(measured), parts[0].unionByName(parts[1])):
        got = {r.measure: r for r in op8_quality.quantiles(sketch, ["lang"]).collect()}["repeat_ratio"]
        assert got.n_docs == 4000
        for q, v in ((25, got.q25), (50, got.q50)):
            true = np.quantile(values / 1000, q / 100, method="inverted_cdf")
            assert abs(v - true) <= true * (op8_quality.BIN - 1)


def expected_verdicts(rows: list[tuple]) -> list[tuple]:
    """(kept, failed rules) of (lang, source, text), by plain sorting and counting: a second reading of the rules."""
    bin_of = lambda v: math.ceil(math.log(v) / math.log(1.02)) if v > 0 else None
    middle = lambda b: 0.0 if b is None else 1.02 ** (b - 0.5)
    measured = []
    for lang, source, text in rows:
        n_words, chars, symbols, dups, repeats, failed = expected_quality(text)
        n_lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
        counts = {"symbol_ratio": (symbols, chars, 8), "dup_line_ratio": (dups, n_lines, 5), "repeat_ratio": (repeats, n_words, 48), "word_length": (chars, n_words, 0)}
        measured.append((lang, source, n_words, failed, counts))

    at = lambda values, q: middle(sorted((bin_of(v) for v in values), key=lambda b: -math.inf if b is None else b)[max(0, math.ceil(q * len(values)) - 1)])

    def level(members: list, ratio: str) -> tuple:
        values, sizes = [m[4][ratio][0] / m[4][ratio][1] for m in members], [m[4][ratio][1] for m in members]
        above = [v for v in values if v > 0]
        mid = at(values, 0.5)
        return len(members), mid, 2 * (mid - at(values, 0.25)), len(above), at(above, 0.1) / 2 if above else 0.0, members[0][4][ratio][2] / at(sizes, 0.5)

    def blended(n, mid, spread, n_above, low, wider):
        own = max(mid + 8 * spread, low)
        weight = n if mid + 8 * spread >= low else n_above
        return (weight * own + 50 * wider) / (weight + 50) if own else wider

    worded = [m for m in measured if m[2]]
    by_lang, by_source = {}, {}
    for m in worded:
        by_lang.setdefault(m[0], []).append(m)
        by_source.setdefault(m[:2], []).append(m)
    limits = {}
    for ratio in op8_quality.RATIOS:
        n, mid, spread_a, above, low, step = level(worded, ratio)
        all_limit = blended(n, mid, spread_a, above, low, step)
        for key, members in by_source.items():
            n, mid, spread_l, above, low, _ = level(by_lang[key[0]], ratio)
            spread_l = max(spread_l, spread_a / 2)
            lang_limit = blended(n, mid, spread_l, above, low, all_limit)
            n, mid, spread, above, low, _ = level(members, ratio)
            limits[key, ratio] = blended(n, mid, max(spread, spread_l / 2), above, low, lang_limit)
    out = []
    for lang, source, n_words, failed, counts in measured:
        beyond = [r for r, (n, size, least) in counts.items() if n_words and n >= least and n / size > limits[(lang, source), r]]
        out.append((not failed and not beyond, ",".join(beyond)))
    return out


def test_verdicts_of_edge_cases_and_the_small_table(spark, docs, rows, small, sample_rows):
    verdict = lambda found: sorted((str(r.doc_id), r.n_words, r.word_chars, r.kept, r.failed_rules) for r in found)
    want = lambda rows: sorted((str(i), *expected_quality(t)[:2], *v) for (i, _, _, t), v in zip(rows, expected_verdicts([r[1:] for r in rows]), strict=True))
    assert verdict(op8_quality.quality(docs).collect()) == want([(r[0], r[2], r[3], r[1]) for r in rows])
    whole = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang", "source", "text").collect()
    assert verdict(op8_quality.op8_quality_rules(spark, small).collect()) == want([tuple(r) for r in whole])


def test_the_sketch_of_a_source_sets_its_thresholds_and_verdicts(spark):
    rng = np.random.default_rng(8)
    prose = lambda n, letters: " ".join("".join(rng.choice(list("abcdefghijklmnop"), max(1, letters + rng.integers(-2, 3)))) for _ in range(n))
    marked = lambda text, of: " ".join(w + "#" * (i % 10 < of) for i, w in enumerate(text.split()))
    rows = [(i, prose(60, 5), "en", "short") for i in range(240)] + [(1000 + i, prose(60, 10), "en", "long") for i in range(240)]
    # Two in five are mostly symbols: the limit is that of the rest.
    rows += [(2000 + i, " ".join(w + "####" for w in prose(60, 5).split()) if i % 5 < 2 else prose(60, 5), "en", "dirty") for i in range(240)]
    # Source code: symbols are its usual text. And a group of one text, which has its language's limit.
    rows += [(4000 + i, marked(prose(60, 5), 4 + i % 3), "en", "code") for i in range(240)] + [(5000, prose(60, 5), "en", "single")]
    # A text of long words and one of some symbols, in each source.
    some = marked(prose(60, 5), 6)
    rows += [(3000, prose(60, 10), "en", "short"), (3001, prose(60, 10), "en", "long"), (3002, some, "en", "short"), (3003, some, "en", "code")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    limits = {r.source: r for r in op8_quality.thresholds(op8_quality.sketches(op8_quality.measure(docs))).collect()}
    assert limits["short"].max_symbol_ratio < 0.1 < limits["code"].max_symbol_ratio
    # Where symbols are rare too, the limit is that of the sketch's upper part: half of what junk has at least.
    assert 0.15 < limits["dirty"].own_symbol_ratio < 0.25 and limits["single"].own_symbol_ratio is None
    found = {r.doc_id: r for r in op8_quality.quality(docs).collect()}
    assert {i: (r.kept, r.failed_rules) for i, r in found.items()} == {r[0]: v for r, v in zip(rows, expected_verdicts([(x[2], x[3], x[1]) for x in rows]), strict=True)}
    assert found[3002].failed_rules == "symbol_ratio" and found[3003].kept  # the same text
    assert all(found[i].kept for i in [*range(240), *range(1000, 1240), *range(4000, 4240), 5000])
    for i in range(240):  # junk doesn't pass for being common
        assert ("symbol_ratio" in found[2000 + i].failed_rules) == (i % 5 < 2)


# -- operator 9 ----------------------------------------------------------------------------------


def tokens(text: str | None) -> list[str]:
    return [*WORD.findall((text or "").translate(UPPER)), ""]


def segmentations(word: str, p: lattice.Pieces, logp: np.ndarray) -> float:
    """The sum over all segmentations, by plain recursion."""
    if not word:
        return 1.0
    total = math.exp(sum(logp[p.byte[b]] for b in word[0].encode())) * segmentations(word[1:], p, logp)
    for j in range(1, len(word) + 1):
        if word[:j] in p.text:
            total += math.exp(logp[p.text[word[:j]]]) * segmentations(word[j:], p, logp)
    return total


def test_a_word_is_the_sum_of_its_segmentations():
    p = lattice.pieces(PIECES)
    logp = lattice.prior(p)
    words = ["a", "river", "straße", "日本", "don't", "zzqx", "🙂x"]
    scored, counts = lattice.Lattice(p, logp).score(words, np.ones(len(words)))
    for w, s in zip(words, scored, strict=True):
        assert math.isclose(s, math.log(segmentations(lattice.MARK + w, p, logp)), rel_tol=1e-9)
    # Expected pieces: the derivative of the log probability by each piece's weight.
    alone = lattice.Lattice(p, logp)
    for i in (p.text["▁river"], p.text["r"], p.text["iv"]):
        step = logp.copy()
        step[i] += 1e-5
        more = lattice.Lattice(p, step).score(words)[0].sum() - alone.score(words)[0].sum()
        assert math.isclose(counts[i], more / 1e-5, rel_tol=1e-3, abs_tol=1e-6)


def test_long_words_score_as_short_ones_do(monkeypatch):
    p = lattice.pieces(PIECES)
    words = ["internationalisation" * 3, "abc" * 20]
    one, n1 = lattice.Lattice(p, lattice.prior(p)).score(words, np.ones(2))
    monkeypatch.setattr(lattice, "LONG", 4)
    two, n2 = lattice.Lattice(p, lattice.prior(p)).score(words, np.ones(2))
    assert np.allclose(one, two) and np.allclose(n1, n2)


def test_scores_of_edge_cases(docs, rows, empty):
    training = ~op9_lm.held_out()
    found = op9_lm.score_texts(docs, training, PIECES).collect()
    learns = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1 for r in rows]
    counts = Counter(t for r, yes in zip(rows, learns, strict=True) if yes for t in tokens(r[1]))
    total, kinds = counts.total(), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens(t))
    want = sorted((len(tokens(r[1])), sum(counts[w] > 0 for w in tokens(r[1])), yes, round(base(r[1]), 6)) for r, yes in zip(rows, learns, strict=True))
    assert sorted((r.n_tokens, r.n_known, r.training, round(r.base_score, 6)) for r in found) == want
    assert {r.train_tokens for r in found} == {total}
    by_text = {}
    for r in found:
        assert r.score < 0 and math.isfinite(r.score)
        by_text.setdefault(r.doc_id, r)
    assert math.isclose(by_text[4].score, by_text[5].score) and math.isclose(by_text[4].score, by_text[9].score)
    assert op9_lm.score_texts(empty, training, PIECES).collect() == []


def test_trained_scores_are_the_lattice_over_learned_weights(spark, docs, rows):
    """The model as a whole against a plain one: expected counts of all training words, then forward sums."""
    training = ~op9_lm.held_out()
    found = {r.doc_id: r for r in op9_lm.score_texts(docs, training, PIECES).collect()}
    p = lattice.pieces(PIECES)
    learns = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1]
    counts = Counter(t for r in learns for t in tokens(r[1]))
    ends = counts.pop("")
    expected = lattice.Lattice(p, lattice.prior(p)).score(list(counts), np.array(list(counts.values()), float))[1]
    smooth = np.append(expected, ends) + op9_lm.SMOOTHING
    weights = np.log(smooth / smooth.sum())
    model = lattice.Lattice(p, weights[:-1])
    for r in rows:
        if r[0] in (4, 6, 10, 12, 17, 22):
            want = (model.score(tokens(r[1])[:-1])[0].sum() + weights[-1]) / math.log(10)
            assert math.isclose(found[r[0]].score, want, rel_tol=1e-9)


def test_no_training_text(docs):
    found = op9_lm.score_texts(docs, F.lit(False), PIECES).collect()
    assert {r.train_tokens for r in found} == {0} and {r.n_known for r in found} == {0}
    assert all(math.isfinite(r.score) for r in found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \t\n\x0b\x1c\x85  éAZ"), max_size=30), min_size=1, max_size=4))
def test_words_of_any_texts(texts):
    words = textscan.Words(texts, lower=True)
    got = [words.data[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends, strict=True)]
    assert got == [w for t in texts for w in WORD.findall(t.translate(UPPER))]
    assert np.diff(words.first).tolist() == [len(WORD.findall(t)) for t in texts]
    by_word = {}
    for w, h in zip(got, words.hashes.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_words_of_many_blocks_are_dealt_to_several_tasks(spark, docs, monkeypatch):
    """Every word of more than one block counts as frequent here; the scores are the same."""
    score = lambda: Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in op9_lm.score_texts(docs, ~op9_lm.held_out(), bpe.vocabulary("piece_bpe_32k.model")).collect())
    want = score()
    monkeypatch.setattr(op9_lm, "LARGE", 1)
    assert docs.rdd.getNumPartitions() > 1 and score() == want
