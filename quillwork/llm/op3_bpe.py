"""Operator 3, BPE encoding and decoding (method: segment tree over adjacent pair ranks, ``bpe.py``).

Edge cases: a null or empty text has no ids and decodes to the empty text; texts of any length are
encoded whole; special strings inside a text are special tokens, as in the library; repeated rows,
equal texts and null ids each give a row; further input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillwork.llm import bpe
from quillwork.llm.common import documents, mapped, slices


def encode(docs: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, ids array<int>): the ids of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocab_path)
        for rows, texts in slices(batches):
            ids = [np.frombuffer(b, "<i4") for b in coder.encode_batch(texts)]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate([*ids, np.zeros(0, np.int32)]))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists], schema=schema)

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, text): what the ids stand for, special tokens kept; null ids count as none."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocab_path)
        for rows in batches:
            texts = [coder.decode(ids or []) for ids in rows.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(texts, pa.string())], schema=schema)

    return mapped(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) in one pass: ids aren't moved between tasks."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocab_path)
        for rows, texts in slices(batches):
            sizes, ids_sha, text_sha = [], [], []
            for raw in coder.encode_batch(texts):
                sizes.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode_bytes(np.frombuffer(raw, "<u4")) if coder.joined_by_space else coder.decode(np.frombuffer(raw, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], schema=schema)

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(documents(spark, sf_dir), bpe.vocabulary("word_bpe_49k.json"))
