"""Pluggable batch encoders of text. A remote or local model may be given; without one, or where it
fails, hashed words stand in, so that a row is never lost."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType
from zlib import crc32

#: Rows whose vectors a task holds at once, however many Spark hands it.
ENCODED_ROWS = 256

Encoder = Callable[[list[str]], "list[list[float]] | None"]


def hashed(texts: list[str], size: int) -> list[list[float]]:
    out = []
    for text in texts:
        v = np.zeros(size)
        for w in (text or "").lower().split():
            h = crc32(w.encode())
            v[h % size] += 1 if h & 0x10000 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def encode(df: DataFrame, column: str, size: int, encoder: Encoder | None = None, attempts: int = 3) -> DataFrame:
    """``df`` with a vector of each text and the name of the encoder that made it."""
    schema = StructType([*df.schema.fields, StructField("vector", ArrayType(DoubleType())), StructField("encoder", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (whole.iloc[i : i + ENCODED_ROWS] for whole in batches for i in range(0, len(whole), ENCODED_ROWS)):
            texts, vectors = b[column].tolist(), None
            for _ in range(attempts if encoder else 0):
                try:
                    vectors = encoder(texts)
                except Exception:  # the service's failures are its own; the fallback is the answer
                    vectors = None
                if vectors is not None:
                    break
            name = "hashed" if vectors is None else "model"
            yield b.assign(vector=hashed(texts, size) if vectors is None else vectors, encoder=name)

    return df.mapInPandas(run, schema)
