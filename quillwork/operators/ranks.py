"""Exact order statistics of groups of any size, by radix selection.

Each round splits the range that holds a rank and keeps the part with the rank in it: first by sign and
exponent, so one far value doesn't put all others into one part, then into ``PARTS`` equal parts at a
time, as ten more bits of the value. It ends when a range holds ``MOST`` rows or one value, after seven rounds
at the most; only rows of that range are sorted. A round moves a count, a least and a greatest value for each
group, rank and part, summed before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.operators.components import written

PARTS = 1024
#: Rows that one task may sort for a group's rank.
MOST = 1 << 16


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)), F.lit(True))


def _part(v: Column, low: Column, high: Column) -> Column:
    """The part of a value within its range; a greater value never has a lesser part. A range that spans more than two
    powers of two is split by sign and exponent, any other one into equal parts."""
    x, a, b = (c.cast("double") for c in (v, low, high))
    exponent = lambda c: F.when(c == 0, 0).otherwise(F.signum(c) * (F.floor(F.log2(F.abs(c))) + 1100)).cast("int")
    wide = exponent(b) - exponent(a) > 1
    return F.when(wide, exponent(x)).otherwise(F.least(F.lit(PARTS - 1), F.floor((x - a) / (b - a) * PARTS)).cast("int"))


def ranked_values(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], most: int = MOST) -> DataFrame:
    """keys and, by name, the value at each rank of each group: an expression over ``n``, the number of its
    values, from 1 to n. Null values don't count."""
    return _ranges(rows, keys, value, ranks, most)[0]


def _ranges(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], most: int) -> tuple[DataFrame, DataFrame, int]:
    """The values at the ranks, the ranges that were sorted (their rows: ``c``), and the rounds it took."""
    known = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    ours = [f"of_{k}" for k in keys]
    own = [F.col(k).alias(o) for k, o in zip(keys, ours, strict=True)]
    ends = known.groupBy(*own).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()])
    state = ends.withColumn("want", F.explode(wanted)).select(*ours, F.col("want.name").alias("name"), F.col("want.rank").alias("left"), "low", "high", F.col("n").alias("c"))
    state, rounds = written(state), 0
    open_ = (F.col("c") > most) & (F.col("low") < F.col("high"))

    def inside(ranges: DataFrame) -> DataFrame:
        return known.join(ranges, _same(keys, ours) & F.col("v").between(F.col("low"), F.col("high")))

    while not state.filter(open_).isEmpty():
        parts = inside(state.filter(open_)).groupBy(*ours, "name", "left", _part(F.col("v"), F.col("low"), F.col("high")).alias("part"))
        parts = parts.agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("c").over(Window.partitionBy(*ours, "name").orderBy("part"))  # one row a part
        at = parts.withColumn("before", upto - F.col("c")).filter((F.col("left") > F.col("before")) & (F.col("left") <= F.col("before") + F.col("c")))
        state = written(state.filter(~open_).unionByName(at.select(*ours, "name", (F.col("left") - F.col("before")).alias("left"), "low", "high", "c")))
        rounds += 1

    values = inside(state).groupBy(*ours, "name", "left", "v").agg(F.count(F.lit(1)).alias("c"))
    reached = F.sum("c").over(Window.partitionBy(*ours, "name").orderBy("v")) >= F.col("left")
    found = values.withColumn("reached", reached).filter("reached")
    named = found.groupBy(*[F.col(o).alias(k) for k, o in zip(keys, ours, strict=True)])
    return named.agg(*[F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks]), state, rounds


def nearest_rank(q: float) -> Column:
    """The rank of the least value that a share ``q`` of the values doesn't exceed."""
    return F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n") - 1e-9))
