"""Operator 12, suffix-array dedup (method: difference-cover blockwise construction).

Every byte covered by a string of WINDOW bytes that starts anywhere else too is removed. Equal strings
are neighbours where suffixes are sorted by their first WINDOW bytes; which suffixes have to be sorted is
told by a difference cover.

* The cover is a set of residues modulo ``v`` of which every difference occurs. Of two suffixes that
  are equal for WINDOW bytes, some place less than ``v`` bytes on lies on the cover in both, and the
  samples there, of WINDOW - v + 1 bytes, are equal. Cover samples (14 of 183 places) are ranked first: they go
  to buckets by fingerprint, a bucket is sorted alone, and samples of one rank are marked as tied.
* Only a suffix with a tied sample less than ``v`` bytes on can have a long tie; the ranks decide it
  for all others. Those left are dealt to suffix buckets by the fingerprint of their WINDOW bytes, and a
  bucket is sorted alone. Windows that meet an equal one cover the bytes to be removed.

Order among suffixes matters only in that equal ones meet, so fingerprints (64 bits; those of samples 32
within a bucket, as a false tie there costs work and no result) stand in for bytes: a suffix sent with
bytes and ranks would be some 300 bytes long in place of 8. Two different windows share a fingerprint with a
chance of n*n/2**65 for n candidates.

What moves: a sample or candidate is 4 or 8 bytes in a block of its bucket, and comes back as a bit. What
occurs twice in a block of texts is known to be tied and goes once, so a passage of a third of all
documents sends a bucket one row for each block. A bucket has BUCKET entries on average, however many
there are in all, and a task holds one bucket at a time. Texts aren't moved, but for those with tied samples
where the list of these is too large for a broadcast.

Copies: texts are addressed by SHA-256; one row of those with copies takes part, for others to meet, and
the copies' bytes are all removed. Edge cases: a null text counts as empty; a text shorter than the
window is left alone, also if it has copies; repeated rows are copies; matches never cross texts; texts of any
length are fingerprinted in strips; an empty table gives no row; further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm.common import documents, mapped, with_groups, within, written
from quillwork.llm.textscan import U, mix, powers
from quillwork.shipping import ship

WINDOW = 400
#: Bytes of texts that are looked at together, bytes fingerprinted at once, and entries of a bucket.
BLOCK, STRIP, BUCKET = 16 << 20, 1 << 18, 1 << 18
#: Bytes of keys and places that may be broadcast.
SMALL = 32 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SALT = np.random.Generator(np.random.PCG64(41)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def difference_cover(q: int) -> tuple[int, list[int]]:
    """v = q*q + q + 1 and q + 1 residues, each difference of which occurs once but 0 (q prime): exponents of the
    powers of a root of a cubic over q elements that lie in a plane."""
    v = q * q + q + 1
    for a, b, c in product(range(q), repeat=3):
        power, found = (1, 0, 0), []
        for i in range(v):
            if power[2] == 0:
                found.append(i)
            power = (a * power[2]) % q, (power[0] + b * power[2]) % q, (power[1] + c * power[2]) % q
        if len({(x - y) % v for x in found for y in found}) == v and len(found) == q + 1:
            return v, found
    raise ValueError(f"{q} is no prime")


def cover_of(window: int) -> tuple[int, list[int]]:
    """A cover of about half the window, for samples of at least the other half."""
    return difference_cover(max([q for q in (2, 3, 5, 7, 11, 13, 17, 19, 23) if q * q + q + 1 <= window // 2 + 1] or [2]))


def fingerprints(data: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Fingerprint of the ``depth`` bytes from each place (in order) on."""
    out = np.empty(len(places), np.uint64)
    up, down = powers(_BASE, STRIP + depth), powers(_INVERSE, STRIP + 1)
    for begin in range(0, len(data), STRIP):
        i, j = np.searchsorted(places, (begin, begin + STRIP))
        if i < j:
            part = _SALT[data[begin : begin + STRIP + depth]]
            part *= up[: len(part)]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
            at = places[i:j] - begin
            out[i:j] = mix((sums[at + depth] - sums[at]) * down[at])
    return out


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Rows with their texts in blocks of about ``size`` bytes; a longer text is a block of its own."""
    held, n = [], 0
    for batch in batches:
        start = 0
        for i, length in enumerate(batch.column("bytes").to_pylist()):
            if n and n + length > size:
                yield pa.concat_batches([*held, batch.slice(start, i - start)])
                held, n, start = [], 0, i
            n += length
        held.append(batch.slice(start))
    if n:
        yield pa.concat_batches(held)


def joined_bytes(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all texts' bytes, where each begins, where it ends)."""
    raws = [t.encode("utf-8") for t in block.column("text").to_pylist()]
    ends = np.cumsum([len(r) for r in raws])
    return np.frombuffer(b"".join(raws), np.uint8), ends - np.array([len(r) for r in raws]), ends


SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("alone", pa.binary()), ("several", pa.binary()), ("note", pa.binary())])
SENT_DDL = "bucket long, block long, alone binary, several binary, note binary"


def packed(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([a.nbytes for a in arrays], "<i8").tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data, "<i8", len(kinds)), 8 * len(kinds), []
    for kind, size in zip(kinds, sizes.tolist(), strict=True):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def flagged_repeats(prints: np.ndarray) -> np.ndarray:
    """Whether each is there more than once."""
    order = np.argsort(prints, kind="stable")
    same = prints[order][1:] == prints[order][:-1]
    out = np.zeros(len(prints), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def sent(block: int, prints: np.ndarray, note: bytes, bits: int, kind: str) -> pa.RecordBatch:
    """A block's fingerprints as rows by bucket (their first ``bits`` bits), and one that keeps what the block needs
    to read the reply. Fingerprints that occur again within the block are tied: they go once and need none."""
    bucket_of = lambda x: (x >> U(64 - bits)).astype(np.uint32 if bits > 16 else np.uint16) if bits else np.zeros(len(x), np.uint16)
    repeats = flagged_repeats(prints)
    alone, several = prints[~repeats], np.unique(prints[repeats])
    buckets = bucket_of(alone)
    order, buckets_of_several = np.argsort(buckets, kind="stable"), bucket_of(several)
    full = np.union1d(buckets, buckets_of_several)  # of the buckets only those that the block has entries of
    a, b = (list(zip(np.searchsorted(x, full, "left").tolist(), np.searchsorted(x, full, "right").tolist(), strict=True)) for x in (buckets[order], buckets_of_several))
    alone, several = alone[order].astype(kind), several.astype(kind)
    whole = packed(np.packbits(repeats), buckets, np.array([len(prints), bits], "<i8"))
    columns = (
        [*full.tolist(), -1 - block],
        [block] * (len(full) + 1),
        [*(alone[i:j].tobytes() for i, j in a), None],
        [*(several[i:j].tobytes() for i, j in b), None],
        [*(None for _ in full), packed(np.frombuffer(whole, np.uint8), np.frombuffer(note, np.uint8))],
    )
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SENT, strict=True)], schema=SENT)


ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("tied", pa.binary()), ("note", pa.binary())])


def sorted_bucket(kind: str) -> Callable[[pa.Table], pa.Table]:
    """Sorts one bucket: which of each block's fingerprints are there more than once, as bits."""

    def run(rows: pa.Table) -> pa.Table:
        block, bucket = rows.column("block").to_pylist(), rows.column("bucket").to_pylist()
        if bucket[0] < 0:
            return pa.table([rows.column("block"), rows.column("bucket"), pa.nulls(len(block), pa.binary()), rows.column("note")], schema=ANSWER)
        alone = [np.frombuffer(x, kind) for x in rows.column("alone").to_pylist()]
        several = [np.frombuffer(x, kind) for x in rows.column("several").to_pylist()]
        known = np.unique(np.concatenate(several))
        prints = np.concatenate(alone)
        tied = flagged_repeats(prints)
        if len(known):
            tied |= known[np.minimum(np.searchsorted(known, prints), len(known) - 1)] == prints
        ends = np.cumsum([len(x) for x in alone])
        bits = [np.packbits(tied[e - len(x) : e]).tobytes() for x, e in zip(alone, ends, strict=True)]
        return pa.table([pa.array(block, pa.int64()), pa.array(bucket, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(len(block), pa.binary())], schema=ANSWER)

    return run


def read_back(finish: Callable[[bytes, np.ndarray], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """Puts the answers to a block's fingerprints in the order of these: ``finish`` gets its note and the ties."""

    def run(rows: pa.Table) -> pa.Table:
        bits = {}
        for bucket, tied, note in zip(*(rows.column(c).to_pylist() for c in ("bucket", "tied", "note")), strict=True):
            if bucket < 0:
                whole, own = unpacked(note, "u1", "u1")
            else:
                bits[bucket] = tied
        sizes = np.frombuffer(whole[-16:].tobytes(), "<i8")
        n, width = int(sizes[0]), int(sizes[1])
        repeats, buckets, _ = unpacked(whole.tobytes(), "u1", "<u4" if width > 16 else "<u2", "<i8")
        tied = np.unpackbits(repeats, count=n).astype(bool)
        alone = np.flatnonzero(~tied)
        full, counts = np.unique(buckets, return_counts=True)
        answers = [np.unpackbits(np.frombuffer(bits[k], np.uint8), count=c) for k, c in zip(full.tolist(), counts.tolist(), strict=True)]
        if answers:
            tied[alone[np.argsort(buckets, kind="stable")]] = np.concatenate(answers).astype(bool)
        return finish(own.tobytes(), tied)

    return run


def names_of(block: pa.RecordBatch) -> list[np.ndarray]:
    """What tells a block's texts apart: SHA-256, doc_id, whether that is there."""
    ids = block.column("doc_id")
    keys = np.frombuffer(b"".join(block.column("key").to_pylist()), np.uint8)
    return [keys, ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)]


def named(names: list[np.ndarray], which: list[int]) -> list[pa.Array]:
    keys, ids, there = names
    raw = keys.tobytes()
    return [pa.array([raw[32 * i : 32 * i + 32] for i in which], pa.binary()), pa.array([int(ids[i]) if there[i] else None for i in which], pa.int64())]


def exchange(blocked: DataFrame, kind: str, finish: Callable[[bytes, np.ndarray], pa.Table], ddl: str) -> DataFrame:
    ship(blocked.sparkSession)
    answers = blocked.groupBy("bucket").applyInArrow(sorted_bucket(kind), "block long, bucket long, tied binary, note binary")
    return answers.groupBy("block").applyInArrow(read_back(finish), ddl)


def bits_for(entries: int, bucket: int = BUCKET) -> int:
    return max(0, (max(entries, 1) // bucket).bit_length())


def block_number(i: int) -> int:
    """Of a partition's i-th block: the same when a task runs again."""
    return (TaskContext.get().partitionId() << 32) + i


FOUND = "key binary, doc_id long, n long, places array<long>"


def merged(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals, in order of text and begin, where one begins within or at the end of another of its text."""
    if not len(text):
        return text, begin, end
    # Ends grow with begins within a text, as all are of one kind of length or cut by the text's end.
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (begin[1:] > end[:-1])])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(text) - 1]])
    return text[new], begin[new], end[last]


def by_text(names: list[np.ndarray], text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Table:
    """A row for each text that has an interval: its names, the intervals' length in all, and their bounds."""
    which, first = np.unique(text, return_index=True)
    bounds = pa.array(np.stack([begin, end], axis=1).ravel().astype(np.int64))
    parts = pa.array(2 * np.append(first, len(text)), pa.int32())
    return pa.table(
        [
            *named(names, which.tolist()),
            pa.array(np.add.reduceat(end - begin, first) if len(first) else [], pa.int64()),
            pa.ListArray.from_arrays(parts, bounds),
        ],
        names=["key", "doc_id", "n", "places"],
    )


def places_in(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within it) for so many entries of each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]


def sampled(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of all cover samples of texts of these sizes."""
    v, cover = cover_of(window)
    d = np.array(cover, np.int64)
    most = sizes - (window - v + 1)
    owner, i = places_in(np.where(most < 0, 0, most // v * len(d) + np.searchsorted(d, most % v, "right")))
    return owner, i // len(d) * v + d[i % len(d)]


def long_tie_candidates(texts: DataFrame, total_bytes: int, window: int = WINDOW, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """texts: key, doc_id, text, bytes. Of each text with a tied cover sample the places where a window that may be
    repeated starts: key, doc_id, n (such places), places (bounds)."""
    v, cover = cover_of(window)
    depth, bits = window - v + 1, bits_for(total_bytes * len(cover) // v, bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, part in enumerate(blocks(batches, block)):
            data, begin, end = joined_bytes(part)
            text, place = sampled(end - begin, window)
            prints = fingerprints(data, begin[text] + place, depth)
            yield sent(block_number(i), prints, packed((end - begin).astype("<i8"), *names_of(part)), bits, "<u4")

    def finish(note: bytes, tied: np.ndarray) -> pa.Table:
        sizes, *names = unpacked(note, "<i8", "u1", "<i8", "u1")
        text, place = sampled(sizes, window)
        text, place = text[tied], place[tied]
        low, high = np.maximum(place - v + 1, 0), np.minimum(place, sizes[text] - window) + 1
        some = low < high
        return by_text(names, *merged(text[some], low[some], high[some]))

    return exchange(mapped(texts.select("key", "doc_id", "text", "bytes"), run, SENT_DDL), "<u4", finish, FOUND)


def repeated(texts: DataFrame, candidates: int, window: int = WINDOW, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """texts: key, doc_id, text, bytes, places (of candidates). Of each text the bytes that a repeated window
    covers: key, doc_id, n (such bytes), places (bounds of maximal runs)."""
    bits = bits_for(candidates, bucket)

    def spread(counts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = bounds.reshape(-1, 2)
        owner, i = places_in(pairs[:, 1] - pairs[:, 0])
        return np.repeat(np.arange(len(counts)), counts // 2)[owner], pairs[owner, 0] + i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, part in enumerate(blocks(batches, block)):
            data, begin, _ = joined_bytes(part)
            places = part.column("places")
            counts, bounds = (x.to_numpy(zero_copy_only=False).astype("<i8") for x in (pc.list_value_length(places), places.flatten()))
            text, place = spread(counts, bounds)
            yield sent(block_number(i), fingerprints(data, begin[text] + place, window), packed(counts, bounds, *names_of(part)), bits, "<u8")

    def finish(note: bytes, tied: np.ndarray) -> pa.Table:
        counts, bounds, *names = unpacked(note, "<i8", "<i8", "u1", "<i8", "u1")
        text, place = spread(counts, bounds)
        text, place = text[tied], place[tied]
        return by_text(names, *merged(text, place, place + window))

    return exchange(mapped(texts.select("key", "doc_id", "text", "bytes", "places"), run, SENT_DDL), "<u8", finish, FOUND)


def content_key(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def texts_of(docs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """key, doc_id, text and bytes of the rows of ``docs`` that ``rows`` (key, doc_id, further columns; a written table)
    names; the names alone are broadcast while they are small."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.octet_length("text").alias("bytes"), content_key().alias("key"))
    r = rows.select(F.col("key").alias("row_key"), F.col("doc_id").alias("row_doc"), *columns)
    return t.join(within(r, SMALL), (F.col("key") == F.col("row_key")) & F.col("doc_id").eqNullSafe(F.col("row_doc"))).select("key", "doc_id", "text", "bytes", *columns)


def repeated_spans(docs: DataFrame, window: int = WINDOW, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """A written table with a row for each row of ``docs``: doc_id, key (SHA-256 of the text), n_bytes, copies (rows of
    this text), n_removed and spans (begin and end in bytes of each maximal removed run, as a flat array)."""
    paths = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), content_key().alias("key"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")), "paths")
    counted = paths.groupBy("key").agg(F.min("doc_id").alias("holder"), F.count(F.lit(1)).alias("copies"))
    several = written(counted.filter("copies > 1").withColumnRenamed("key", "copies_key"), "copies")
    rows = with_groups(paths, "key", several, "copies_key", "copies", "doc_id")
    rows = written(rows.select("doc_id", "key", "n_bytes", F.coalesce("copies", F.lit(1)).alias("copies"), "holder"), "rows")
    total = rows.filter(F.col("n_bytes") >= window).agg(F.sum("n_bytes")).first()[0] or 0

    # Every text once: of those with copies, which are known to be repeated, one row.
    others = rows.filter("copies > 1 and not doc_id <=> holder").select(F.col("key").alias("other_key"), F.col("doc_id").alias("other_doc"))
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.octet_length("text").alias("bytes"), content_key().alias("key")).filter(F.col("bytes") >= window)
    once = t.join(within(others, SMALL), (F.col("key") == F.col("other_key")) & F.col("doc_id").eqNullSafe(F.col("other_doc")), "left_anti")

    candidates = written(long_tie_candidates(once, total, window, bucket, block).dropDuplicates(["key", "doc_id"]), "candidates")
    n = candidates.agg(F.sum("n")).first()[0] or 0
    found = written(repeated(texts_of(docs, candidates, "places"), n, window, bucket, block), "repeated")

    # A text without copies has one row.
    alone = rows.filter("copies = 1").join(found.select(F.col("key").alias("found_key"), "n", "places"), F.col("key") == F.col("found_key"), "left")
    none = F.array().cast("array<long>")
    alone = alone.select("doc_id", "key", "n_bytes", "copies", F.coalesce("n", F.lit(0)).alias("n_removed"), F.coalesce("places", none).alias("spans"))
    gone = F.col("n_bytes") >= window
    copied = rows.filter("copies > 1").select("doc_id", "key", "n_bytes", "copies", F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(gone, F.array(F.lit(0).cast("long"), "n_bytes")).otherwise(none).alias("spans"))
    return alone.unionByName(copied)


def kept_bytes(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """spans: rows of ``repeated_spans``. key and kept, the bytes that remain, of the texts that lose some and keep
    some; bytes, as a run may begin or end within a code point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            kept = []
            for text, bounds in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                raw, at, pieces = text.encode("utf-8"), 0, []
                for a, b in zip(bounds[::2], bounds[1::2], strict=True):
                    pieces.append(raw[at:a])
                    at = b
                kept.append(b"".join([*pieces, raw[at:]]))
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(kept, pa.binary())], names=["key", "kept"])

    some = spans.filter("copies = 1 and n_removed > 0 and n_removed < n_bytes")
    return mapped(texts_of(docs, some, "spans"), run, "key binary, kept binary")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    spans = written(repeated_spans(docs), "spans")
    kept = kept_bytes(docs, spans).select(F.col("key").alias("kept_key"), F.sha2("kept", 256).alias("kept_sha"))
    alone = spans.filter("copies = 1").join(kept, F.col("key") == F.col("kept_key"), "left").drop("kept_key")
    rows = alone.unionByName(spans.filter("copies > 1").withColumn("kept_sha", F.lit(None).cast("string")))
    nothing, untouched = F.sha2(F.lit("").cast("binary"), 256), F.lower(F.hex("key"))
    digest = F.when(F.col("n_removed") == 0, untouched).when(F.col("n_removed") == F.col("n_bytes"), nothing).otherwise(F.col("kept_sha"))
    return rows.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), digest.alias("kept_sha256"))
