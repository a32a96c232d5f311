"""Operators 1, 3, 4 and 10 against the tokenizers library."""

from __future__ import annotations

import glob
import hashlib
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillwork.llm import bpe, op1_shards, op3_bpe, op4_counts, op10_packing
from quillwork.llm.common import shared_dir

WORD, BYTE = bpe.vocabulary("word_bpe_49k.json"), bpe.vocabulary("byte_bpe_50k.json")


@lru_cache
def library(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def ids_of(text: str | None, path: str = WORD) -> list[int]:
    return library(path).encode(text or "", add_special_tokens=False).ids


def raw(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_any_text_is_encoded_and_decoded_as_the_library_does(path, text):
    ids = next(bpe.load(path).encode_batch([text]))
    assert np.frombuffer(ids, "<u4").tolist() == ids_of(text, path)
    assert bpe.load(path).decode(np.frombuffer(ids, "<u4")) == library(path).decode(ids_of(text, path), skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.text("abcdeil nrst'", min_size=1, max_size=500))
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_long_words_are_merged_as_in_the_library(path, text):
    word = text.replace(" ", "") * 3
    assert np.frombuffer(next(bpe.load(path).encode_batch([word])), "<u4").tolist() == ids_of(word, path)


def test_both_trees_merge_alike():
    coder, rng = bpe.load(BYTE), random.Random(3)
    for n in (2, 3, 7, 64, 191, 192):
        word = "".join(rng.choice("abcdeilnrst") for _ in range(n)).encode()
        assert coder._merge_many([word], max(2, 1 << (n - 1).bit_length()))[0] == coder._merge_long(word).astype("<u4").tobytes()


def test_round_trip_of_every_text(docs, rows):
    found = sorted(tuple(r) for r in op3_bpe.round_trip_digests(docs.select("doc_id", "text"), WORD).select("ids_sha256", "n_tokens", "decoded_sha256").collect())
    want = []
    for _, text, *_ in rows:
        ids = ids_of(text)
        said = library(WORD).decode(ids, skip_special_tokens=False)
        want.append((hashlib.sha256(raw(ids)).hexdigest(), len(ids), hashlib.sha256(said.encode()).hexdigest()))
    assert found == sorted(want)


def test_encode_and_decode_give_ids_and_texts(docs, rows):
    encoded = op3_bpe.encode(docs, BYTE)
    assert sorted(r.ids for r in encoded.collect()) == sorted(ids_of(r[1], BYTE) for r in rows)
    assert sorted(r.text for r in op3_bpe.decode(encoded, BYTE).collect()) == sorted(r[1] or "" for r in rows)


def test_counts_of_every_text(docs, rows):
    found = sorted(tuple(r) for r in op4_counts.token_counts(docs, BYTE, 100).select("n_bytes", "n_tokens", "over_limit").collect())
    assert found == sorted((len((r[1] or "").encode()), n := len(ids_of(r[1], BYTE)), n > 100) for r in rows)


def test_a_long_text_is_split_where_no_token_spans():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abc'é1!\n") for _ in range(rng.randrange(1, 9))) for _ in range(3000)) + "z" * 3000
    for limit in (50, 997):
        parts = list(bpe.segments(text, limit))
        assert "".join(parts) == text and len(parts) > 5
        assert [i for p in parts for i in ids_of(p, BYTE)] == ids_of(text, BYTE)


def whole(rows_found, docs_rows) -> None:
    """Pieces cover each document's ids exactly once, with the right checksums."""
    pieces = defaultdict(list)
    for r in rows_found:
        pieces[r.doc_id].append(r)
    texts = defaultdict(list)
    for doc_id, text, *_ in docs_rows:
        texts[doc_id].append(raw([*ids_of(text), 1]))
    assert pieces.keys() == texts.keys()
    for doc_id, raws in texts.items():
        found = sorted((r.start, r.length, r.ids_crc32) for r in pieces[doc_id])
        if len(set(raws)) == 1:
            for data in raws[:1]:
                parts = sorted((s, n) for s, n, _ in found)
                assert sum(n for _, n in parts) == len(raws) * len(data) // 4
                assert all(c == zlib.crc32(data[4 * s : 4 * (s + n)]) for s, n, c in found)
        else:
            assert sum(n for _, n, _ in found) == sum(len(d) // 4 for d in raws)
            assert all(any(c == zlib.crc32(d[4 * s : 4 * (s + n)]) for d in raws) for s, n, c in found)


def test_packing_holds_every_id_once(docs, rows):
    found = op10_packing.pack_documents(docs, WORD, with_ids=True).collect()
    whole(found, rows)
    windows = defaultdict(list)
    for r in found:
        assert r.ids and len(r.ids) == r.length and zlib.crc32(raw(r.ids)) == r.ids_crc32
        windows[r.sequence_id].append(r)
    padding = 0
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        tier = pieces[0].tier
        assert at <= tier <= 2048 and {r.tier for r in pieces} == {tier} and len({r.step_group for r in pieces}) == 1
        padding += tier - at
    assert padding <= 3 * 2048  # one window a partition at most
    step_groups(found, parts=3)


def step_groups(found: list, parts: int) -> None:
    """Every step group holds the same tokens, but for one a partition, and is of one tier but for the last ones."""
    groups = defaultdict(list)
    for r in {r.sequence_id: r for r in found}.values():
        groups[r.step_group].append(r.tier)
    short = [g for g, tiers in groups.items() if sum(tiers) != op10_packing.STEP_TOKENS]
    assert len(short) <= parts and all(sum(groups[g]) < op10_packing.STEP_TOKENS for g in short)
    assert sum(len(set(t)) > 1 for t in groups.values()) <= 4 * parts


def test_step_groups_and_windows_over_many_runs(docs, rows, monkeypatch):
    monkeypatch.setattr(op10_packing, "RUN_DOCS", 10)
    one = docs.coalesce(1)
    found = op10_packing.pack_documents(one, WORD).collect()
    whole(found, rows)
    step_groups(found, parts=1)
    monkeypatch.setattr(op10_packing, "RUN_DOCS", 4096)
    monkeypatch.setattr(op10_packing, "RUN_TOKENS", 3000)  # the long documents are beyond a run each
    found = op10_packing.pack_documents(one, WORD).collect()
    whole(found, rows)
    step_groups(found, parts=1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=60))
def test_packing_of_any_sizes(sizes):
    tiers = (16, 64, 128)
    windows = op10_packing.pack(sizes, tiers)
    seen = sorted((d, s, n) for _, w in windows for d, s, n in w)
    for doc, size in enumerate(sizes):
        at = 0
        for _, start, length in [p for p in seen if p[0] == doc]:
            assert start == at
            at += length
        assert at == size
    assert sum(t != sum(p[2] for p in w) for t, w in windows) <= 1


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_the_permutation_is_a_bijection(n):
    slots = op1_shards.permute(np.arange(n), n, 7)
    assert sorted(slots.tolist()) == list(range(n))
    assert (op1_shards.permute(np.arange(n), n, 7) == slots).all()
    if n > 10:
        assert (op1_shards.permute(np.arange(n), n, 8) != slots).any() and (slots != np.arange(n)).mean() > 0.9


def test_shards_hold_every_sequence_at_its_slot(spark, docs, rows):
    layout = op1_shards.Layout(length=256, shard_records=50)
    folder = f"{shared_dir(spark)}/shards"
    found = op1_shards.materialise(docs, WORD, layout, folder=folder).collect()
    slots = {r.sequence: r.slot for r in found}
    n = len(slots)
    assert sorted(slots) == sorted(slots.values()) == list(range(n))
    assert slots == dict(enumerate(op1_shards.permute(np.arange(n), n, layout.key).tolist()))
    # The files themselves: fixed stride, in slot order.
    data = {}
    for path in glob.glob(f"{folder.removeprefix('file://')}/part-*"):
        shard, content = int(path.rsplit("part-", 1)[1].split("-")[0]), open(path, "rb").read()
        assert len(content) % layout.stride == 0
        for k in range(len(content) // layout.stride):
            data[shard * layout.shard_records + k] = layout.ids(content[k * layout.stride : (k + 1) * layout.stride])
    assert sorted(data) == list(range(n))
    texts = defaultdict(list)
    for doc_id, text, *_ in rows:
        texts[doc_id].append([*ids_of(text), 1])
    held = defaultdict(int)
    for r in found:
        ids = data[r.slot][r.offset : r.offset + r.length].astype("<u2")
        assert r.record_tokens == len(data[r.slot]) and r.record_crc32 == zlib.crc32(data[r.slot].tobytes())
        assert r.shard == r.slot // 50 and r.record == r.slot % 50 and zlib.crc32(ids.tobytes()) == r.ids_crc32
        assert any(d[r.start : r.start + r.length] == ids.tolist() for d in texts[r.doc_id])
        held[r.doc_id] += r.length
    assert held == {k: sum(map(len, v)) for k, v in texts.items()}


def test_a_resumed_read_is_the_tail_of_a_full_read(spark, docs, empty):
    layout = op1_shards.Layout(length=256, shard_records=50)
    folder = shared_dir(spark)
    pieces = op1_shards.materialise(docs, WORD, layout, folder=folder).collect()
    read = lambda first: {r.slot: r.ids for r in op1_shards.read_from(spark, folder, layout, first).collect()}
    full = read(0)
    n = len(full)
    assert n > 120 and sorted(full) == list(range(n)) == sorted({r.slot for r in pieces})
    for r in pieces:
        assert len(full[r.slot]) == r.record_tokens
        assert zlib.crc32(np.array(full[r.slot][r.offset : r.offset + r.length], "<u2").tobytes()) == r.ids_crc32
    for first in (1, 50, 77, n - 1, n, n + 500):
        assert read(first) == {k: v for k, v in full.items() if k >= first}


def test_ids_that_a_layout_cannot_hold_are_refused(docs):
    assert op1_shards.layout_for(WORD).width == 2
    op1_shards.Layout(width=2).check(1 << 16)
    op1_shards.Layout(width=4).check(1 << 17)
    with pytest.raises(ValueError, match="65537 ids"):
        op1_shards.Layout(width=2).check((1 << 16) + 1)
    with pytest.raises(Exception, match="ids don't fit into 1 bytes"):
        op1_shards.sequences(docs, WORD, op1_shards.Layout(width=1), 1).collect()


def test_shards_of_wide_ids(spark, docs):
    layout = op1_shards.Layout(length=100, shard_records=64, width=4)
    folder = shared_dir(spark)
    pieces = op1_shards.materialise(docs, WORD, layout, folder=folder).collect()
    full = {r.slot: r.ids for r in op1_shards.read_from(spark, folder, layout).collect()}
    for r in pieces:
        assert r.record_tokens == len(full[r.slot]) and r.record_crc32 == zlib.crc32(raw(full[r.slot]))
        assert r.ids_crc32 == zlib.crc32(raw(full[r.slot][r.offset : r.offset + r.length]))


def test_counts_of_texts_longer_than_a_segment(monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT_CHARS", 50)
    texts = ["ab cd  ef\n gh " * 40 + "<|endoftext|>" + "x" * 300 + " y" * 90, "word " * 100 + "<|endoftext|> after" * 9, "日本語 x " * 60]
    assert bpe.load(BYTE).count_batch(texts) == [len(ids_of(t, BYTE)) for t in texts]


def test_the_cache_is_bounded_by_words_and_by_characters(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    monkeypatch.setattr(bpe, "CACHE_CHARS", 500)
    coder = bpe.Bpe(WORD)
    for texts in (["a b c d e f g h i j k l m n o p q r s t u v"], ["w x y"], ["z" * 600, "a"], ["again a b"]):
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode_batch(texts)] == [ids_of(t) for t in texts]
    assert len(coder._places) <= 23 and coder._chars < 1200


def test_empty_tables(empty):
    assert op3_bpe.round_trip_digests(empty, WORD).collect() == []
    assert op4_counts.token_counts(empty, BYTE, 5).collect() == []
    assert op10_packing.pack_documents(empty, WORD).collect() == []
    assert op1_shards.materialise(empty, WORD).collect() == []


@pytest.mark.parametrize("first", [0, 9, 10, 123, 99_999, 100_000, 123_456, 909_090])
def test_patterns_of_shards_take_all_from_a_number_on(first):
    import fnmatch

    alternatives = op1_shards.shards_from(first).removeprefix("part-{").removesuffix("}-*").split(",")
    near = {n for base in (0, first, 10 * first, 99_990, 999_990) for n in range(max(0, base - 120), base + 120)}
    for n in near:
        assert any(fnmatch.fnmatchcase(f"{n:05d}", a) for a in alternatives) == (n >= first), n
    assert len(alternatives) < 20
