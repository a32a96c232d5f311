"""Operator 8, quality rules (method: adaptive thresholds from mergeable quantile sketches).

One pass measures every whole text. For each (lang, source) and each ratio and size a sketch is kept:
counts of logarithmic bins, so quantiles have a relative error of ``BIN - 1`` at most and two sketches
merge by adding counts, in any order and with the same result each time.

A group's limit of a ratio comes from its own sketch of that ratio, in one of two ways, whichever is more.
Where texts usually have some of what it counts, it is the median plus ``FENCE`` spreads; the spread is
twice the distance from the lower quartile to the median: junk raises a ratio and never lowers it, so a
source of two fifths junk has the limit of its clean part and can't switch a rule off. Where most texts have
none, median and spread are 0, and the upper part of the sketch tells what having some looks like: the limit
is half of the tenth of the values above 0 (``LOW``, ``PART``). It is blended with the limit of its language,
which counts as ``PRIOR`` values, and that one with the limit of all documents likewise, each weighted by the
values that it rests on (all texts, or those above 0), so there is no size at which a group's threshold is
switched on; that of all documents is blended with what ``EVENTS`` are in a text of the median size. A text
fails a rule beyond its group's limit if it has as many as ``EVENTS``, the least that counts as evidence. Thresholds
are joined back to the documents on (lang, source, salt): a hot source is spread over ``SALTS`` tasks.

Edge cases: a null or empty text has no words, no lines and no ratios, and fails the base rule;
null lang or source is a group of its own; repeated rows each count and give a row; an empty table
gives no row; further input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwork.llm.common import documents, mapped, slices, written
from quillwork.llm.textscan import LEAD, SPACE, Words, mix

#: Ratio: what it counts, over which size, and the least count at which a text may fail.
RATIOS = {"symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
EVENTS = {"symbol_ratio": 8, "dup_line_ratio": 5, "repeat_ratio": 48, "word_length": 0}
SIZES = ("word_chars", "n_lines", "n_words")
BIN = 1.02
FENCE = 8.0
#: Of the values above 0, and the part of it that is the limit where most values are 0.
LOW, PART = 0.1, 0.5
PRIOR = 50
SALTS = 16
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_U = np.uint64


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] - total[bounds[:-1]]


def measure_texts(texts: list[str]) -> dict[str, list[int]]:
    """The base counts of each text."""
    words = Words(texts)
    n_words = np.diff(words.first)
    word_chars = _sums(LEAD[words.data] & ~SPACE[words.data], words.text_starts)
    symbols = _sums(_SYMBOL[words.data], words.text_starts)
    hashes, bounds = words.windows(8)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    keys = mix(hashes + owner.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    first_word = words.first[:-1][owner[at]] + at - bounds[:-1][owner[at]]
    covered = np.zeros(len(words.starts) + 9, np.int64)
    np.add.at(covered, first_word, 1)
    np.add.at(covered, first_word + 8, -1)
    repeats = _sums(np.cumsum(covered)[: len(words.starts)] > 0, words.first)
    lines, dup_lines = [], []
    for text in texts:
        # White space of ASCII alone makes no word; other white space is a character of a word.
        with_word = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
        lines.append(len(with_word))
        dup_lines.append(len(with_word) - len(set(with_word)))
    return {"n_words": n_words.tolist(), "word_chars": word_chars.tolist(), "n_symbols": symbols.tolist(), "n_dup_lines": dup_lines, "n_repeat_words": repeats.tolist(), "n_lines": lines}


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *((c, pa.int64()) for c in counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            found = measure_texts(texts)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(found[c], pa.int64()) for c in counts)], schema=schema)

    ddl = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in counts)
    return mapped(docs.select("doc_id", "text", F.col("lang").cast("string"), F.col("source").cast("string")), run, ddl)


def ratios(measured: DataFrame) -> DataFrame:
    over = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    return measured.withColumns({r: over(*of) for r, of in RATIOS.items()})


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure (a ratio or a size), bin, n: texts with a word only; bin null holds the zeros."""
    pairs = ", ".join(f"'{m}', double({m})" for m in (*RATIOS, *SIZES))
    rows = ratios(measured).filter("n_words > 0").selectExpr("lang", "source", f"stack({len(RATIOS) + len(SIZES)}, {pairs}) as (measure, value)")
    place = F.when(F.col("value") > 0, F.ceil(F.log("value") / math.log(BIN))).cast("int")
    return rows.groupBy("lang", "source", "measure", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """n_docs, n_above (values above 0), q25, q50 and low, the LOW quantile of the values above 0 (null without any),
    of each group and measure of a sketch merged to ``keys``."""
    by = [*keys, "measure"]
    merged = sketch.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by)
    upto = group.orderBy(F.col("bin").asc_nulls_first())
    zeros = F.sum(F.when(F.col("bin").isNull(), F.col("n")).otherwise(0)).over(group)
    ranked = merged.withColumns({"upto": F.sum("n").over(upto), "n_docs": F.sum("n").over(group), "zeros": zeros, "value": F.coalesce(F.pow(F.lit(BIN), F.col("bin") - 0.5), F.lit(0.0))})
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("n_docs"), F.col("value"))).alias(f"q{int(q * 100)}")
    low = F.min(F.when(F.col("bin").isNotNull() & (F.col("upto") - F.col("zeros") >= LOW * (F.col("n_docs") - F.col("zeros"))), F.col("value")))
    return ranked.groupBy(*by).agg(F.max("n_docs").alias("n_docs"), F.max(F.col("n_docs") - F.col("zeros")).alias("n_above"), at(0.25), at(0.5), low.alias("low"))


def _levels(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
    """A row per group: its number of documents and, for each ratio, its median, spread, low value, how many are
    above 0, and what EVENTS are in a text of the median size."""
    found = quantiles(sketch, keys)
    of = lambda measure, q: F.max(F.when(F.col("measure") == measure, F.col(q)))
    columns = [F.max("n_docs").alias(f"{name}_n")]
    for r, (_, size) in RATIOS.items():
        columns += [of(r, "q50").alias(f"{name}_mid_{r}"), (2 * (of(r, "q50") - of(r, "q25"))).alias(f"{name}_spread_{r}")]
        columns += [of(r, "low").alias(f"{name}_low_{r}"), of(r, "n_above").alias(f"{name}_above_{r}"), (F.lit(float(EVENTS[r])) / of(size, "q50")).alias(f"{name}_step_{r}")]
    return found.groupBy(*[F.col(k).alias(f"{name}_{k}") for k in keys]).agg(*columns)


def _own(r: str, name: str, spread: Column) -> tuple[Column, Column]:
    """(what a group's own sketch says, on how many values): null without any above 0."""
    fence = F.col(f"{name}_mid_{r}") + FENCE * spread
    low = PART * F.col(f"{name}_low_{r}")
    return F.nullif(F.greatest(fence, low), F.lit(0.0)), F.when(fence >= F.coalesce(low, F.lit(0.0)), F.col(f"{name}_n")).otherwise(F.col(f"{name}_above_{r}"))


def _limit(r: str, name: str, spread: Column, wider: Column) -> Column:
    """A group's limit, blended with the limit of the wider group that it's part of."""
    own, n = _own(r, name, spread)
    return F.coalesce((n * own + PRIOR * wider) / (n + PRIOR), wider)


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source and two columns of each ratio: max_, the value beyond which a text of that group fails, and own_, what
    the group's own sketch says, null where it has no value above 0."""
    groups, langs = _levels(sketch, ["lang", "source"], "s"), _levels(sketch, ["lang"], "l")
    out = groups.join(langs, F.col("s_lang").eqNullSafe(F.col("l_lang")))
    # Of all documents there is one row of numbers.
    every = _levels(sketch, [], "a").first().asDict()
    out = out.withColumns({c: F.lit(v).cast("double") for c, v in every.items()})
    limits = []
    for r in RATIOS:
        # However even its texts, a group may spread half as far as the wider one.
        spread_a = F.col(f"a_spread_{r}")
        spread_l = F.greatest(F.col(f"l_spread_{r}"), spread_a / 2)
        spread_s = F.greatest(F.col(f"s_spread_{r}"), spread_l / 2)
        limits.append(_limit(r, "s", spread_s, _limit(r, "l", spread_l, _limit(r, "a", spread_a, F.col(f"a_step_{r}")))).alias(f"max_{r}"))
        limits.append(_own(r, "s", spread_s)[0].alias(f"own_{r}"))
    return out.select(F.col("s_lang").alias("lang"), F.col("s_source").alias("source"), *limits)


def quality(docs: DataFrame) -> DataFrame:
    """A row per input row: doc_id, the counts, base_failed, kept and the rules that failed it."""
    measured = written(measure(docs), "measures")
    limits = thresholds(written(sketches(measured), "sketches"))
    limits = limits.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[f"max_{r}" for r in RATIOS], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("t_salt"))
    salted = ratios(measured).withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(SALTS)).cast("int"))
    same = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")) & (F.col("salt") == F.col("t_salt"))
    beyond = lambda r: (F.col(r) > F.col(f"max_{r}")) & (F.col(RATIOS[r][0]) >= EVENTS[r])
    failed = F.filter(F.array(*[F.when(beyond(r), F.lit(r)) for r in RATIOS]), lambda x: x.isNotNull())
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return salted.join(limits, same, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & (F.size(failed) <= 0)).alias("kept"), F.array_join(failed, ",").alias("failed_rules")
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))
