"""What a task holds is bounded, however large the batches are that Spark hands it."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillwork.functions import encoders
from quillwork.operators import external, retrieval
from quillwork.plans import registry


class Handed:
    """A frame whose one batch is handed to the function at hand."""

    schema = StructType([StructField("id", LongType()), StructField("text", StringType())])

    def mapInPandas(self, run, schema):
        return list(run(iter([pd.DataFrame({"id": range(1000), "text": [f"word {i}" for i in range(1000)]}), pd.DataFrame({"id": [], "text": []})])))


@pytest.mark.parametrize("made", [lambda rows: encoders.encode(rows, "text", 8), lambda rows: external.fanned_out(rows, "text", {"one": lambda text, attempt: text})])
def test_a_large_batch_is_taken_in_parts(made):
    out = made(Handed())
    assert max(map(len, out)) <= 256 and pd.concat(out)["id"].tolist() == list(range(1000))


def test_a_task_has_the_pairs_of_a_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ROWS_BLOCK", 8)
    monkeypatch.setattr(retrieval, "ASKED_BLOCK", 4)
    v = spark.range(0, 1600, numPartitions=2).selectExpr("id as vec_id", "array(cast(id % 7 as float), 1f) as embedding")
    pairs = retrieval.block_pairs(v.filter("vec_id % 20 = 0"), v)
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 200 * pairs.select("q_ids").distinct().count() and max(sizes) <= 4 * retrieval.TASK_BLOCKS**2


def test_lines_are_aligned_where_their_texts_are(spark, tmp_path):
    texts = ["a\nb 1\na\n\nb", "no figures\nat all", "1\n2", "", None, "x\n٣\nx 3\nx"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df, want = registry.QUERIES["unchanged_lines"](spark, str(tmp_path)), []
    for i, text in enumerate(texts):
        a = (text or "").split("\n")
        b = "\n".join(x for x in a if not set(x) & set("0123456789")).split("\n")
        want += [(i, m.a + k, m.b + k) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for k in range(m.size)]
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
