"""Vectors of texts, each text encoded once: a folder of vectors by content that every run appends to.

A text is known by its SHA-256, a model by its name, so another model's vectors lie beside the first one's. A run encodes
only what the folder lacks for its model, each text once however many rows hold it, and joins vectors back to all rows. A run
that is lost before its rows are committed leaves the folder as it was. Texts for which the model has no answer aren't kept, so
the next run asks again; their rows have the stand-in's vector and say so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions.encoders import Encoder, encode, hashed
from quillwork.operators.components import written

ENTRY = "content binary, model string, vector array<double>"
#: Copies of one text are dealt to so many tasks where they meet its vector.
SALTS = 16


def cached_vectors(rows: DataFrame, column: str, folder: str, size: int, encoder: Encoder | None = None, model: str = "hashed", attempts: int = 3) -> DataFrame:
    """``rows`` with content, vector (unit, of ``size`` components) and encoder, which says whose it is. Without an encoder hashed words
    are the model. A null text counts as empty."""
    spark = rows.sparkSession
    content = F.unhex(F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256))
    named = rows.withColumn("content", content)
    spark.createDataFrame([], ENTRY).write.mode("append").parquet(folder)  # the first run finds a folder too
    known = spark.read.schema(ENTRY).parquet(folder).filter(F.col("model") == model)
    wanted = named.groupBy("content").agg(F.first(F.coalesce(column, F.lit(""))).alias("text"))
    unseen = wanted.join(known.select("content"), "content", "left_anti")
    own = encoder or (lambda texts: hashed(texts, size))
    made = written(encode(unseen, "text", size, own, attempts).drop("text"))
    kept = made.filter("encoder = 'model'").select("content", F.lit(model).alias("model"), "vector")
    kept.write.mode("append").parquet(folder)
    old = known.select("content", "vector", F.lit(model).alias("encoder"))
    new = made.select("content", "vector", F.when(F.col("encoder") == "model", model).otherwise(F.col("encoder")).alias("encoder"))
    # Rows of this run's texts that were unseen are in the folder by now as well: one of the two is taken.
    every = written(old.join(new.select("content"), "content", "left_anti").unionByName(new)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = named.withColumn("salt", (F.rand(7) * SALTS).cast("int"))
    return dealt.join(every, ["content", "salt"], "left").drop("salt")
