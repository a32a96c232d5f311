"""What the operators of this subpackage share: places for written tables, and text batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwork.operators.components import gone_at_exit
from quillwork.operators.components import shared_folder as shared_dir
from quillwork.shipping import ship

__all__ = ["documents", "free", "gone_at_exit", "mapped", "rows_kept", "salted", "shared_dir", "slices", "with_groups", "within", "written"]

#: Text handed to a Python helper at once; a single longer text is handed over alone.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, ddl)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: cuts the lineage, survives the loss of any executor, and is deleted when the
    application ends."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    path = f"{folder}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    gone_at_exit(spark, folder)
    return spark.read.schema(df.schema).parquet(path)


def within(df: DataFrame, most_bytes: int) -> DataFrame:
    """``df``, a written table, marked for broadcast if its rows are of so many bytes at most, strings
    and arrays of any length included; else as it is, for a shuffled join."""
    size = sum((F.octet_length(F.col(c).cast("string")) if kind in ("string", "binary") or kind.startswith("array") else F.lit(8) for c, kind in df.dtypes), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most_bytes else df


def salted(many: DataFrame, few: DataFrame, spread_by: Column, salts: int) -> tuple[DataFrame, DataFrame, str]:
    """Both sides of a join with a column more, by whose name they join as well: a hot key of ``many`` is
    spread over ``salts`` tasks, and ``few`` is there once for each."""
    (name,) = free(few, *free(many, "salt_of_join"))
    return many.withColumn(name, F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")), few.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), name


def with_groups(rows: DataFrame, row_key: str, groups: DataFrame, group_key: str, size: str, by: str, large: int = 1024, salts: int = 16) -> DataFrame:
    """``rows`` left-joined to ``groups``, a written table of one row a key and the ``size`` of its group. The
    rows of a large group are dealt to ``salts`` tasks by ``by``; the large ones, of which there is one for
    ``large`` rows at most, are marked by a join of their own."""
    key, mark, part, at = free(rows, *free(groups, "large_key", "is_large", "row_part", "group_part"))
    large_ones = written(groups.filter(F.col(size) > large).select(F.col(group_key).alias(key), F.lit(True).alias(mark)), "large")
    marked = rows.join(within(large_ones, 8 << 20), F.col(row_key) == F.col(key), "left")
    dealt = marked.withColumn(part, F.when(F.col(mark), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(0).cast("int")).drop(key, mark)
    parts = F.when(F.col(size) > large, salts - 1).otherwise(0)
    told = groups.withColumn(at, F.explode(F.sequence(F.lit(0), parts)))
    return dealt.join(told, (F.col(row_key) == F.col(group_key)) & (F.col(part) == F.col(at)), "left").drop(part, at)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it one that ``df`` lacks."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def rows_kept(docs: DataFrame, decisions: DataFrame, by: str = "kept") -> DataFrame:
    """Rows of ``docs`` that ``decisions`` (doc_id, h, a flag ``by``) keep, with all their columns. A row is
    known by its doc_id and the hash of its text; of repeated rows one is kept."""
    doc, h, n, place = free(docs, "key_doc", "key_hash", "key_rows", "key_place")
    keys = decisions.groupBy("doc_id", "h").agg(F.max(by).alias("kept"), F.count(F.lit(1)).alias(n)).filter("kept")
    keys = keys.select(F.col("doc_id").alias(doc), F.col("h").alias(h), n)
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(h))
    once = docs.join(keys.filter(F.col(n) == 1).hint("shuffle_hash"), same, "left_semi")
    several = keys.filter(F.col(n) > 1)
    if several.isEmpty():
        return once
    # Repeated rows are few or alike; the window sees only those whose id and text occur again.
    nth = F.row_number().over(Window.partitionBy(doc, h).orderBy(F.lit(1)))
    again = docs.join(several, same).withColumn(place, nth).filter(F.col(place) == 1)
    return once.unionByName(again.select(*[f"`{c}`" for c in docs.columns]))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cuts Arrow batches by bytes of text: (rows, their texts with null as empty)."""
    for batch in batches:
        n, start, held = batch.num_rows, 0, 0
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for i, size in enumerate(sizes):
            if held and held + size > BATCH_BYTES:
                part = batch.slice(start, i - start)
                yield part, [t or "" for t in part.column(column).to_pylist()]
                start, held = i, 0
            held += size
        if start < n:
            part = batch.slice(start)
            yield part, [t or "" for t in part.column(column).to_pylist()]
