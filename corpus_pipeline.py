"""The corpus pipeline: language ID, exact dedup, near dedup, secret scans and packing, in stages.

A stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``. Between stages the rows are a
written table. Texts in no language go, of equal texts and of each group of near copies one stays,
secrets are replaced by their kind, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillwork.llm import bpe, op2_minhash, op5_secrets, op6_exact, op7_langid, op10_packing
from quillwork.llm.common import documents, rows_kept, shared_dir, written


#: Setting of the session: the folder of a ledger of scans that lasts.
LEDGER = "quillwork.secrets.ledger"


#: Rows that go to a Python worker at once: some MB of text in place of tens, in the worker and in the executor.
ROWS_AT_ONCE = 1024


def bounded_batches(spark: SparkSession) -> None:
    """Has this session hand rows to Python workers ROWS_AT_ONCE at a time at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) not in range(1, ROWS_AT_ONCE + 1):
        spark.conf.set(key, str(ROWS_AT_ONCE))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no language: null, empty, without a letter, or far from every language learned."""
    bounded_batches(spark)
    return op7_langid.accepted(docs, op7_langid.train(docs, ~op7_langid.held_out()))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of texts that are equal but for white space."""
    bounded_batches(spark)
    return rows_kept(docs, op6_exact.exact_groups(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest doc_id of each component of near copies."""
    bounded_batches(spark)
    return rows_kept(docs, op2_minhash.near_groups(docs), "kept_row")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every row, with secrets replaced by their kind. Where the session names a folder in LEDGER, the ledger
    there is extended, and only what it lacks is scanned."""
    bounded_batches(spark)
    folder = spark.conf.get(LEDGER, None) or f"{shared_dir(spark)}/ledger"
    paths = op5_secrets.extend_ledger(docs, folder)
    return op5_secrets.redacted(docs, op5_secrets.report(op5_secrets.findings(paths, op5_secrets.read_ledger(spark, folder))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all rows into sequences: a row per piece."""
    bounded_batches(spark)
    return op10_packing.pack_documents(docs, bpe.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL has no BPE and no trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
