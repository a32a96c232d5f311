"""Operator 6, exact dedup (method: content-defined chunk recipes).

A text, less its white space, is cut where a rolling hash of the last 32 bytes says so, so equal
stretches give equal chunks. A chunk's identifier is 8 bytes of a fast hash, verified against a
SHA-256: all chunks are grouped by identifier, and should two contents share one, SHA-256 takes
its place everywhere. A text's recipe is its ordered list of identifiers. Texts are equal when
their recipes are, so only recipes are shuffled; texts are read once and never moved.

Of equal texts the row with the most code points in the original text stays, then the smallest
doc_id (null last), then the first row in input order. Edge cases: null counts as empty, all texts
without other than white space are equal to each other; of repeated rows (same doc_id, same text)
exactly one is kept; an empty table gives no row; further input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm.common import documents, mapped, salted, slices, written

SPACES = b" \t\n\x0b\x0c\r"
#: Chunk sizes in bytes: no cut before the least, a cut one in MEAN bytes after it, one at the most.
LEAST, MEAN, MOST = 2 << 10, 8 << 10, 64 << 10
SALTS = 16
_GEAR = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of a text's chunks."""
    n = len(data)
    if n <= LEAST:
        return [n]
    # Gear hash of the last 32 bytes at every place: sum of gear[byte i back] << i, by doubling.
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        older = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += older
    places = np.flatnonzero(h < np.uint32((1 << 32) // MEAN)) + 1
    ends, start = [], 0
    while n - start > LEAST:
        i = np.searchsorted(places, start + LEAST)
        end = int(places[i]) if i < len(places) else n
        end = min(end, start + MOST, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def recipes(docs: DataFrame) -> DataFrame:
    """A row per input row: row (its place), doc_id, h (hash of the text), n_code_points, text_sha256
    and its chunks."""
    ddl = "row long, doc_id long, h long, n_code_points long, text_sha256 string, fast binary, strong array<binary>"
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("n_code_points", pa.int64()), ("text_sha256", pa.string()), ("fast", pa.binary()), ("strong", pa.list_(pa.binary()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            sizes, shas, fast, strong = [], [], [], []
            for text in texts:
                data = text.encode("utf-8").translate(None, SPACES)
                ends = cuts(data)
                chunks = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                sizes.append(len(text))
                shas.append(hashlib.sha256(data).hexdigest())
                fast.append(b"".join(map(xxhash.xxh3_64_digest, chunks)))
                strong.append([hashlib.sha256(c).digest() for c in chunks])
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in ("row", "doc_id", "h")), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(fast, pa.binary()), pa.array(strong, schema.field("strong").type)], schema=schema
            )

    return mapped(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("h"), "text"), run, ddl)


def exact_groups(docs: DataFrame) -> DataFrame:
    """A row per input row: row, doc_id, h, keep_id, group_size, kept, text_sha256."""
    found = written(recipes(docs), "recipes")
    chunks = found.select(F.posexplode("strong").alias("at", "strong"), "fast").select(F.expr("substring(fast, at * 8 + 1, 8)").alias("id"), "strong")
    clashes = chunks.groupBy("id").agg(F.min("strong").alias("a"), F.max("strong").alias("b")).filter("a <> b")
    recipe = F.col("fast") if clashes.isEmpty() else F.expr("cast(concat_ws('', transform(strong, c -> hex(c))) as binary)")
    rows = found.select("row", "doc_id", "h", "n_code_points", "text_sha256", recipe.alias("recipe"))
    order = F.struct((-F.col("n_code_points")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
    shared = groups.filter("group_size > 1").select(F.col("recipe").alias("shared_recipe"), "group_size", "best")
    many, few, salt = salted(rows, shared, F.col("row"), SALTS)
    joined = many.join(few.withColumnRenamed(salt, "shared_salt"), (F.col("recipe") == F.col("shared_recipe")) & (F.col(salt) == F.col("shared_salt")), "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "row",
        "doc_id",
        "h",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
        "text_sha256",
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).drop("row", "h")


#: The same rows: the group is the normalised text.
ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       row_number() OVER w = 1 AS kept, s AS text_sha256
FROM t WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
