"""Operator 11, fill-in-middle transformation (method: overlapping-chunk decomposition).

A unit is ``[A-Za-z]+|[^A-Za-z]``. Whether one starts at a place is told by two adjacent
characters: a letter starts one unless a letter precedes it, any other character always does. So a
text is cut into chunks that overlap by one byte, the starts in all chunks of a batch are counted
at once, and prefix sums of the counts send the ranks of both cuts to the chunks that own them; only
those are scanned again for the places.

The cuts and the form come from the SHA-256 of the document's number, so a run gives the same rows
each time, in any order. Forms: ``plain`` (the text), ``psm`` (<P>prefix<S>suffix<M>middle) and ``spm``
(<S>suffix<P>prefix<M>middle). Edge cases: a null text counts as empty, and an empty text or one with a
marker of its own stays plain; a null doc_id is written as no digits; repeated rows each give a row; of
texts of any length a strip of STRIP bytes is looked at at a time; an empty table gives no row;
further input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm.common import documents, mapped, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk, and of a strip of chunks whose starts are counted at once.
CHUNK, STRIP = 4 << 10, 1 << 20
#: Of 100 documents so many stay plain, and of 100 others so many put the suffix first.
PLAIN_OF_100, SUFFIX_FIRST_OF_100 = 10, 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Bytes other than those that continue a code point.
_LEAD = (np.arange(256) & 0xC0) != 0x80


def unit_starts(data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Whether a unit starts at each byte from begin to end; the byte before begin is the overlap."""
    letter = _LETTER[data[max(0, begin - 1) : end]]
    before = letter[:-1] if begin else np.concatenate([[False], letter[:-1]])
    here = letter[1:] if begin else letter
    return _LEAD[data[begin:end]] & ~(here & before)


class Units:
    """Counts of units and code points of the chunks of a batch of texts."""

    def __init__(self, raws: list[bytes]):
        # A line feed before each text: its first letter has no letter before it.
        self.data = np.frombuffer(b"".join(b"\n" + r for r in raws) or b"\n", np.uint8)
        sizes = np.array([len(r) for r in raws], np.int64)
        self.begin = np.cumsum(sizes + 1) - sizes
        chunks = -(-sizes // CHUNK)
        #: Chunks of text i: first[i] to first[i + 1].
        self.first = np.concatenate([[0], np.cumsum(chunks)])
        owner = np.repeat(np.arange(len(raws)), chunks)
        self.chunk_begin = self.begin[owner] + (np.arange(self.first[-1]) - self.first[owner]) * CHUNK
        self.chunk_end = np.minimum(self.chunk_begin + CHUNK, (self.begin + sizes)[owner])
        units, points = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
        at = 0
        while at < len(owner):  # a strip of whole chunks
            to = max(at + 1, int(np.searchsorted(self.chunk_end, self.chunk_begin[at] + STRIP, "right")))
            a, b = int(self.chunk_begin[at]), int(self.chunk_end[to - 1])
            inside = self.chunk_begin[at:to] - a
            # The line feeds between texts belong to no chunk: they are counted as code points and taken off.
            starts, leads = unit_starts(self.data, a, b), _LEAD[self.data[a:b]].copy()
            first, last = np.searchsorted(self.begin - 1, (a, b))
            gaps = self.begin[first:last] - 1 - a
            starts[gaps] = leads[gaps] = False
            units[at:to] = np.add.reduceat(starts, inside, dtype=np.int64)
            points[at:to] = np.add.reduceat(leads, inside, dtype=np.int64)
            at = to
        #: Units and code points of the batch before each chunk.
        self.units, self.points = (np.concatenate([[0], np.cumsum(x)]) for x in (units, points))

    def count(self, i: int) -> int:
        return int(self.units[self.first[i + 1]] - self.units[self.first[i]])

    def place(self, i: int, rank: int) -> tuple[int, int]:
        """(bytes, code points) of text i before its unit of this rank; all of it at the rank of its count."""
        a, b = int(self.first[i]), int(self.first[i + 1])
        if rank >= self.count(i):
            return (int(self.chunk_end[b - 1] - self.begin[i]) if b > a else 0), int(self.points[b] - self.points[a])
        wanted = self.units[a] + rank
        c = int(np.searchsorted(self.units[a : b + 1], wanted, "right")) - 1 + a
        begin, end = int(self.chunk_begin[c]), int(self.chunk_end[c])
        at = int(np.flatnonzero(unit_starts(self.data, begin, end))[wanted - self.units[c]])
        points = self.points[c] - self.points[a] + np.count_nonzero(_LEAD[self.data[begin : begin + at]])
        return begin + at - int(self.begin[i]), int(points)


def draws(doc_id: int | None, salt: str) -> list[int]:
    """Four numbers of 32 bits that belong to a document."""
    digest = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transformed(docs: DataFrame, salt: str = "1:") -> DataFrame:
    """A row per row of ``docs``: doc_id, n (units), form, prefix_chars, middle_chars (null where plain), and
    the training text ``output``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def one(units: Units, i: int, raw: bytes, doc_id: int | None) -> tuple:
        n = units.count(i)
        h1, h2, h3, h4 = draws(doc_id, salt)
        if not raw or h3 % 100 >= 100 - PLAIN_OF_100 or any(x in raw for x in marks):
            return n, "plain", None, None, raw
        (a, a_points), (b, b_points) = (units.place(i, r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
        if h4 % 100 < SUFFIX_FIRST_OF_100:
            return n, "spm", a_points, b_points - a_points, b"".join([s, suffix, p, prefix, m, middle])
        return n, "psm", a_points, b_points - a_points, b"".join([p, prefix, s, suffix, m, middle])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            raws = [t.encode("utf-8") for t in texts]
            units = Units(raws)
            ids = rows.column("doc_id")
            found = [one(units, i, raw, doc_id) for i, (raw, doc_id) in enumerate(zip(raws, ids.to_pylist(), strict=True))]
            n, form, before, inside, output = zip(*found, strict=True)
            outputs = pa.array(output, pa.large_binary()).cast(pa.large_string())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, f.type) for x, f in zip((n, form, before, inside), list(schema)[1:5], strict=True)), outputs], schema=schema)

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of. No piece holds a marker, and none can arise across a seam, so the first
    of each marker is the one that was put there."""
    between = f"substring({output}, 4)"

    def parts(first: str) -> tuple[str, str, str]:
        a = f"locate('{first}', {between})"
        b = f"locate('{MIDDLE}', {between}, {a} + 3)"
        return f"substring({between}, 1, {a} - 1)", f"substring({between}, {a} + 3, {b} - {a} - 3)", f"substring({between}, {b} + 3)"

    prefix, suffix, middle = parts(SUFFIX)
    suffix_, prefix_, middle_ = parts(PREFIX)
    return F.expr(f"case {form} when 'psm' then concat({prefix}, {middle}, {suffix}) when 'spm' then concat({prefix_}, {middle_}, {suffix_}) else {output} end")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    out = transformed(documents(spark, sf_dir))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


#: The same rows: units as a list, pieces as slices of it.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
  CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
  coalesce(array_to_string(units[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
         ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
