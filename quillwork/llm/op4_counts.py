"""Operator 4, token counts (method: batch encoding in Arrow functions that return lengths only).

A batch is encoded as a whole: every word it has not met before is merged once (``bpe.py``), and a
text's count is the sum of its words' lengths; no ids leave the function. Batches are balanced by
bytes of text, and a long text is split at its special strings and before single spaces that no word
spans, so a task's memory doesn't grow with its longest text.

Edge cases: a null or empty text has 0 bytes and 0 tokens; special strings inside a text count as one
token each, as in the library; every row gives a row; further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillwork.llm import bpe
from quillwork.llm.common import documents, mapped, slices


def token_counts(docs: DataFrame, vocab_path: str, limit: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): tokens of every whole text under a byte-level vocabulary."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocab_path)
        for rows, texts in slices(batches):
            counts = coder.count_batch(texts)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])], schema=schema
            )

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), bpe.vocabulary("byte_bpe_50k.json"), limit=1024)
