"""The best candidates of each item by shared words, without making the pairs that can't win.

An item's words are taken from the rarest on. A row that has none of the first ``p`` of an item's ``m`` known
words shares ``m - p`` at most, so once ``k`` rows are known to share ``c`` words, the first ``m - c + 1`` words
reach every row that could take their place, and common words further down are never looked up. A few
candidates of the rarest words give ``c`` (a bound needs no completeness); the words up to the bound, and
``EXTRA`` more, give the rows to be counted, and of these only rows with more than ``EXTRA`` hits can win.

Postings of a word are dealt to ``SALTS`` tasks by row. What is counted in full is a pair of an item and a
row, whose words are in one row of either table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.operators.components import written
from quillwork.operators.latest import ranked

#: Rarest words that give the first candidates, and how many of these an item counts in full for its bound.
SEED, SEEDS = 4, 16
#: Words looked up beyond the bound, so that a row needs one hit more for each.
EXTRA = 2
SALTS = 16


def _hits(postings: DataFrame, prefix: DataFrame) -> DataFrame:
    """item, row and h, the words of the item's prefix that the row has."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return postings.join(prefix.withColumn("salt", salts), ["w", "salt"]).groupBy("item", "row").agg(F.count(F.lit(1)).alias("h"))


def _counted(pairs: DataFrame, items: DataFrame, rows: DataFrame) -> DataFrame:
    """item, row and all words that they share."""
    both = pairs.select("item", "row").join(rows, "row").join(items, "item")
    return both.select("item", "row", F.size(F.array_intersect("row_words", "item_words")).cast("long").alias("shared"))


def best_sharing(items: DataFrame, rows: DataFrame, k: int = 1, ties: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """items: item and words, rows: row and words (arrays of distinct words, ids unique). Returns item, row, shared and
    place of the k rows that share most words with each item, one at least, ties by ``ties`` (the smallest row); and
    the pairs (item, row) that were counted in full to find them."""
    order = [F.desc("shared"), F.col("row") if ties is None else ties]
    asked = written(items.select("item", F.explode("words").alias("w")))
    vocabulary = asked.select("w").distinct()
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")
    postings = written(rows.select("row", F.explode("words").alias("w"), salt).join(vocabulary, "w", "left_semi"))
    frequency = postings.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    placed = ranked(asked.join(frequency, "w"), ["item"], [F.col("df"), F.col("w")])
    placed = written(placed.join(placed.groupBy("item").agg(F.count(F.lit(1)).alias("m")), "item"))
    item_words = placed.groupBy("item").agg(F.collect_list("w").alias("item_words"))
    row_words = written(postings.groupBy("row").agg(F.collect_list("w").alias("row_words")))

    first = ranked(_hits(postings, placed.filter(F.col("place") <= SEED).select("item", "w")), ["item"], [F.desc("h"), F.col("row")])
    seeds = written(_counted(first.filter(F.col("place") <= max(SEEDS, k)), item_words, row_words))
    known = ranked(seeds, ["item"], order).filter(F.col("place") == k).select("item", F.col("shared").alias("c"))

    bounded = placed.join(known, "item", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    needed = F.least(F.col("m"), F.col("m") - F.col("c") + 1 + EXTRA)
    # Of the words beyond the bound as many as were looked up may be all that a winner has in the prefix.
    least = F.greatest(F.lit(1), needed - F.col("m") + F.col("c"))
    prefix = bounded.filter(F.col("place") <= needed).select("item", "w")
    limit = bounded.select("item", least.alias("least")).distinct()
    pairs = written(_hits(postings, prefix).join(limit, "item").filter("h >= least").select("item", "row"))
    best = ranked(_counted(pairs, item_words, row_words), ["item"], order).filter(F.col("place") <= k)
    return best.select("item", "row", "shared", "place"), pairs
