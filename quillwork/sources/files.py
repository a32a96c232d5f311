"""Readers of uploaded files: whole texts, Word documents, CSV rows, JSON stores and event logs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_CHARS = 2 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
TRAINING_ROW = "text string, label string, reason string, source string"


def docx_text(data: bytes) -> str | None:
    """Paragraphs of a Word document, a line each; None if the bytes are no such document."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    lines = []
    for paragraph in root.iter(f"{_W}p"):
        parts = [(e.text or "") if e.tag == f"{_W}t" else " " for e in paragraph.iter() if e.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")]
        lines.append("".join(parts))
    return "\n".join(lines)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, text, unsupported: text and CSV files as they are, Word documents as their paragraphs.
    Files of no bytes aren't listed by Spark's reader and give no row."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            plain = b["path"].str.lower().str.endswith((".txt", ".csv", ".md", ".text"))
            word = b["path"].str.lower().str.endswith(".docx")
            text = [bytes(c).decode("utf-8", "replace") if p else docx_text(bytes(c)) if w else None for c, p, w in zip(b["content"], plain, word, strict=True)]
            yield pd.DataFrame({"path": b["path"], "text": text, "unsupported": [t is None for t in text]})

    return files.mapInPandas(run, "path string, text string, unsupported boolean")


def is_valid_text(text: Column) -> Column:
    """Not blank, and no longer than an upload may be."""
    return (F.length(F.trim(F.coalesce(text, F.lit("")))) > 0) & (F.length(text) <= MOST_CHARS)


def read_training_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=TRAINING_ROW, multiLine=True, escape='"')


def read_json_store(spark: SparkSession, path: str, schema: str, newest: str) -> DataFrame:
    """Entries of one JSON array in a file, newest first."""
    return spark.read.schema(schema).json(path, multiLine=True).orderBy(F.col(newest).desc_nulls_last())


def log_events(lines: DataFrame, schema: str, pattern: str) -> DataFrame:
    """JSON objects at the end of log lines whose ``event`` matches; lines without one are dropped."""
    found = lines.select(F.from_json(F.regexp_extract("value", r"(\{.*\})\s*$", 1), schema).alias("e"))
    return found.filter(F.col("e.event").rlike(pattern)).select("e.*")


def read_log_events(spark: SparkSession, path: str, schema: str, pattern: str) -> DataFrame:
    return log_events(spark.read.text(path), schema, pattern)


def recordset(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of a JSON array of objects held in one column, as typed columns."""
    return df.select(F.inline(F.from_json(column, f"array<struct<{schema}>>")))
