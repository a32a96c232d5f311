"""Operator 10, packing (method: hierarchical multi-length packing).

Every document's tokens are cut into full windows of the longest context and a rest. Rests are
routed to the shortest tier (a power of two) that holds them, and each tier is packed on its own,
longest rests first, into the window whose gap fits best. What a window of a tier still lacks is
filled from shorter tiers, the longest piece that fits first, the last one cut to size. Windows
that the shorter tiers can't fill are laid end to end and cut; what is left at the shortest tier
goes out as the longest context, padded, and all other windows are full. Windows of
a tier are dealt to step groups that each hold ``STEP_TOKENS``, over all runs of a partition; windows
wait until their group is full. What waits at a partition's end, less than a group of each tier, is
dealt to groups of mixed lengths, longest first, so a partition has one group at most that holds fewer.

Packing is local to a run of ``RUN_DOCS`` documents of one partition, so nothing is shuffled and
no key can be hot; a run pads one window at most. sequence_id is unique over all partitions.

Edge cases: a null or empty text is its end token alone; a text of any length is cut into as many
pieces as it needs; every row is packed once, repeated rows and null ids too; an empty table gives
no row; further input columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quillwork.llm import bpe
from quillwork.llm.common import documents, mapped, slices

TIERS = (256, 512, 1024, 2048)
#: Tokens in a step group.
STEP_TOKENS = 8 * 2048
#: Documents packed together; a worker holds the ids of that many at once.
RUN_DOCS = 4096
RUN_TOKENS = 8 << 20

Piece = tuple[int, int, int]  # (document in the run, start, length)


def pack(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """Windows (padded length, pieces in order) that hold each document's tokens exactly once."""
    longest = tiers[-1]
    out: list[tuple[int, list[Piece]]] = []
    pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # sorted (length, document, start)

    def route(doc: int, start: int, length: int) -> None:
        insort(pools[next(t for t in tiers if t >= length)], (length, doc, start))

    for doc, size in enumerate(sizes):
        full = size - size % longest
        out += [(longest, [(doc, start, longest)]) for start in range(0, full, longest)]
        if size > full:
            route(doc, full, size - full)
    for k in range(len(tiers) - 1, -1, -1):
        tier, shorter = tiers[k], [pools[t] for t in reversed(tiers[:k])]
        unfilled: list[Piece] = []
        for gap, window in _best_fit(pools[tier], tier):
            gap = _fill(gap, window, shorter, route)
            if gap:
                unfilled += window
            else:
                out.append((tier, window))
        full_windows, tail = _end_to_end(unfilled, tier)
        out += [(tier, w) for w in full_windows]
        if tail and not k:
            out.append((longest, tail))
        for doc, start, length in tail if k else ():
            for at in range(0, length, tiers[k - 1]):
                route(doc, start + at, min(tiers[k - 1], length - at))
    return out


def _best_fit(pool: list[tuple[int, int, int]], tier: int) -> list[tuple[int, list[Piece]]]:
    """(gap, pieces) of each window, smallest gap first: pieces from the longest, each to the window it fits best."""
    gaps: list[tuple[int, int]] = []
    windows: list[list[Piece]] = []
    full: list[int] = []
    for length, doc, start in reversed(pool):
        at = bisect_left(gaps, (length,))
        if at < len(gaps):
            gap, w = gaps.pop(at)
        else:
            gap, w = tier, len(windows)
            windows.append([])
        windows[w].append((doc, start, length))
        if gap > length:
            insort(gaps, (gap - length, w))
        else:
            full.append(w)
    return [(0, windows[w]) for w in full] + [(gap, windows[w]) for gap, w in gaps]


def _fill(gap: int, window: list[Piece], shorter: list[list[tuple[int, int, int]]], route) -> int:
    """Fills a window's gap from the shorter tiers, longest first; returns what is left if they are used up."""
    while gap:
        for pool in shorter:
            at = bisect_left(pool, (gap + 1,)) - 1
            if at >= 0:
                length, doc, start = pool.pop(at)
                window.append((doc, start, length))
                gap -= length
                break
        else:
            pool = next((p for p in reversed(shorter) if p), None)
            if pool is None:
                break
            length, doc, start = pool.pop(0)
            window.append((doc, start, gap))
            route(doc, start + gap, length - gap)
            gap = 0
    return gap


def _end_to_end(pieces: list[Piece], tier: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Pieces laid one after another and cut at the tier's length: full windows, and the rest."""
    full: list[list[Piece]] = []
    window: list[Piece] = []
    room = tier
    for doc, start, length in pieces:
        while length:
            n = min(length, room)
            window.append((doc, start, n))
            start, length, room = start + n, length - n, room - n
            if not room:
                full.append(window)
                window, room = [], tier
    return full, window


def pack_documents(docs: DataFrame, vocab_path: str, tiers: tuple[int, ...] = TIERS, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """A row per piece: where it stands in its document and in its sequence, the sequence's padded
    length (tier) and step group, a checksum of its ids and, if asked for, the ids."""
    names = "doc_id start length ids_crc32 doc_tokens sequence_id offset tier step_group".split()
    schema = pa.schema([(n, pa.int64()) for n in names] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocab_path)
        end = end_id.to_bytes(4, "little")
        first = TaskContext.get().partitionId() << 33
        made, steps = 0, 0
        waiting: dict[int, list[list[tuple]]] = {t: [] for t in tiers}  # rows of windows whose group isn't full

        def emit(windows: list[list[tuple]]) -> Iterator[tuple]:
            """The rows of a step group."""
            nonlocal steps
            for rows in windows:
                for row in rows:
                    yield (*row[:8], first + steps, *row[8:])
            steps += 1

        def flush(doc_ids: list, raws: list[bytes]) -> Iterator[tuple]:
            nonlocal made
            for tier, window in pack([len(r) // 4 for r in raws], tiers):
                rows, offset = [], 0
                for doc, start, length in window:
                    raw = raws[doc][4 * start : 4 * (start + length)]
                    row = (doc_ids[doc], start, length, zlib.crc32(raw), len(raws[doc]) // 4, first + made, offset, tier)
                    rows.append((*row, np.frombuffer(raw, "<i4")) if with_ids else row)
                    offset += length
                made += 1
                waiting[tier].append(rows)
                if len(waiting[tier]) * tier >= STEP_TOKENS:
                    yield from emit(waiting[tier])
                    waiting[tier] = []

        def rest() -> Iterator[tuple]:
            group, room = [], STEP_TOKENS
            # Tiers divide each other: windows from the longest on fill a group without a gap.
            for tier in reversed(tiers):
                for rows in waiting[tier]:
                    group.append(rows)
                    room -= tier
                    if room <= 0:
                        yield from emit(group)
                        group, room = [], STEP_TOKENS
            if group:
                yield from emit(group)

        def batch_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            columns = list(zip(*rows, strict=True))
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        doc_ids: list = []
        raws: list[bytes] = []
        held = 0
        for batch, texts in slices(batches):
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), coder.encode_batch(texts), strict=True):
                doc_ids.append(doc_id)
                raws.append(raw + end)
                held += len(raw)
                if len(raws) >= RUN_DOCS or held >= 4 * RUN_TOKENS:
                    yield from batch_of(flush(doc_ids, raws))
                    doc_ids, raws, held = [], [], 0
        if raws:
            yield from batch_of(flush(doc_ids, raws))
        yield from batch_of(rest())

    ddl = ", ".join(f"{n} long" for n in names) + ", ids array<int>" * with_ids
    return mapped(docs.select("doc_id", "text"), run, ddl)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), bpe.vocabulary("word_bpe_49k.json"))
