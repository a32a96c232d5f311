"""Clusters of groups of any size by summaries that merge.

A cluster's summary is its count, the sum of its unit vectors and its first id; the summary of two clusters is the sum
of theirs, so clusters built apart merge without their rows. Each range of ids of a group is clustered by itself, rows
joining the nearest centre that is near enough or starting one; then the summaries of ``FAN`` neighbouring ranges are
clustered in the same way, the largest first, round by round until a group has one list. Last, each row is given to the
nearest of its group's centres. A hot group is as many tasks as it has ranges.

Where nearly every row is a cluster of its own, a list is as long as its group. A long list is taken in turns: the
centres found so far are looked through in spans, a task each, for those that a row of the turn is near to; only these
can change, so only these and the turn's rows meet in one task. Rows and centres meet in spans of both at last.

The result isn't that of a fold over all rows in order: centres don't drift with the order of the ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.operators.components import written

#: Rows of a range at most, ranges whose summaries merge, and as many rows or centres as so many ranges hold: those of a span and of a turn.
RANGE, FAN, SPAN, TURN = 4096, 8, 8, 2
#: Summaries that are scored at once while they are gathered, and scores that a span makes at once.
BLOCK, SCORES = 64, 1 << 21
SUMMARY = "grp string, part long, first long, n long, total array<double>"
_COLUMNS = ["grp", "part", "first", "n", "total"]


def _unit(x: np.ndarray) -> np.ndarray:
    """Of length 1; what has none, or a component that is no number, is zeros, which are near to nothing."""
    with np.errstate(invalid="ignore"):
        return np.nan_to_num(x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64)


def _gathered(sums: np.ndarray, counts: np.ndarray, firsts: np.ndarray, least: float, begun: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, counts and first ids of the clusters of summaries, taken in their order: the first ``begun`` are clusters, each
    other joins the nearest centre of a cosine of ``least`` or more, else it starts one."""
    total, n, first = sums.copy(), counts.copy(), firsts.copy()
    unit, k = _unit(sums), begun
    for at in range(begun, len(sums), BLOCK):
        u = _unit(sums[at : at + BLOCK])
        scores = np.empty((len(u), k + len(u)))
        scores[:, :k] = u @ unit[:k].T
        for i, v in enumerate(sums[at : at + BLOCK]):
            best = int(scores[i, :k].argmax()) if k else 0
            if k and scores[i, best] >= least:
                total[best] += v
                n[best] += counts[at + i]
                first[best] = min(first[best], firsts[at + i])
            else:
                best, k = k, k + 1
                total[best], n[best], first[best] = v, counts[at + i], firsts[at + i]
            unit[best] = _unit(total[best])
            scores[i + 1 :, best] = u[i + 1 :] @ unit[best]  # a centre that changed is scored anew
    return total[:k], n[:k], first[:k]


def _table(pdf: pd.DataFrame, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pd.DataFrame:
    total, n, first = found
    return pd.DataFrame({"grp": pdf["grp"].iloc[0], "part": int(pdf["part"].iloc[0]), "first": first, "n": n, "total": list(total)})


def _span_of(key: str, spans: Column) -> Column:
    return F.pmod(F.xxhash64(key), spans)


def _each(spans: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), spans - 1))


def _merged(found: DataFrame, least: float, rows_of_range: int) -> DataFrame:
    """The summaries of each group and part gathered, the largest first, a turn of them at a time."""

    def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["begun", "n", "first"], ascending=[False, False, True])
        return _table(pdf, _gathered(_matrix(pdf["total"]), pdf["n"].to_numpy(), pdf["first"].to_numpy(), least, int(pdf["begun"].sum())))

    def near(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(ours) or not len(theirs):
            return ours[_COLUMNS].iloc[:0]
        centres, u = _unit(_matrix(ours["total"])), _unit(_matrix(theirs["total"]))
        step, best = max(1, SCORES // len(centres)), np.full(len(centres), -1.0)
        for at in range(0, len(u), step):
            best = np.maximum(best, (u[at : at + step] @ centres.T).max(axis=0))
        # A product's rounding depends on its shape. A span has all clusters of one first id.
        return ours.loc[ours["first"].isin(ours["first"][best >= least - 1e-9]), _COLUMNS]

    together = lambda rows: rows.groupBy("grp", "part").applyInPandas(gathered, SUMMARY)
    new, old = F.lit(False).alias("begun"), F.lit(True).alias("begun")
    # Turns follow the order by runs of summaries of one size and range: these are counted, the summaries aren't sorted.
    keys, cell = ["grp", "part", "n", "cell"], F.floor(F.col("first") / rows_of_range).alias("cell")
    cells = found.select("*", cell).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("grp", "part").orderBy(F.desc("n"), "cell")) - F.col("rows")
    cells = written(cells.select(*keys, F.floor(before / (TURN * rows_of_range)).alias("turn")))
    last = cells.agg(F.max("turn").alias("last")).first()["last"] or 0
    if not last:
        return written(together(found.select("*", new)))
    dealt = written(found.select("*", cell).join(cells, keys).select(*_COLUMNS, "turn").sortWithinPartitions("turn"))
    turn = lambda k: dealt.filter(F.col("turn") == k).select(*_COLUMNS)
    held = written(together(turn(0).select("*", new)))
    for k in range(1, last + 1):
        spans, by = F.lit(k).cast("long"), ["grp", "part", "span"]  # k turns gave no more centres than k spans may hold
        ours, theirs = held.withColumn("span", _span_of("first", spans)), turn(k).withColumn("span", _each(spans))
        touched = written(ours.groupBy(*by).cogroup(theirs.groupBy(*by)).applyInPandas(near, SUMMARY))
        stay = held.join(touched.select("grp", "part", "first"), ["grp", "part", "first"], "left_anti").select(*_COLUMNS)
        held = written(stay.union(together(touched.select("*", old).union(turn(k).select("*", new)))))
    return held


def _nearest(dealt: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """grp, id and cluster: each row of ``dealt`` gets the nearest of its group's centres. Rows and centres of a group go to
    spans of about ``most``, each pair of spans is a task's, and of a row's best centres in the spans the best stays."""
    spans = lambda df, name: df.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / most).alias(name))
    sizes = written(spans(dealt, "row_spans").join(spans(found, "centre_spans"), "grp"))
    rows = dealt.join(sizes, "grp").select("grp", "row", "id", "v", _span_of("row", F.col("row_spans")).alias("span"), _each(F.col("centre_spans")).alias("at"))
    centres = found.join(sizes, "grp").select("grp", "first", "total", _span_of("first", F.col("centre_spans")).alias("at"), _each(F.col("row_spans")).alias("span"))

    def run(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(ours) or not len(theirs):
            return pd.DataFrame(columns=["grp", "row", "id", "cluster", "score"])
        theirs = theirs.sort_values("first")
        u, c = _unit(_matrix(ours["v"])), _unit(_matrix(theirs["total"]))
        step, best, score = max(1, SCORES // len(c)), np.empty(len(u), np.int64), np.empty(len(u))
        for at in range(0, len(u), step):
            scores = u[at : at + step] @ c.T
            best[at : at + step], score[at : at + step] = scores.argmax(axis=1), scores.max(axis=1)
        return pd.DataFrame({"grp": ours["grp"], "row": ours["row"], "id": ours["id"], "cluster": theirs["first"].to_numpy()[best], "score": score + 0.0})

    keys = ["grp", "span", "at"]
    scored = rows.groupBy(*keys).cogroup(centres.groupBy(*keys)).applyInPandas(run, "grp string, row long, id long, cluster long, score double")
    one = F.max_by(F.struct("grp", "id", "cluster"), F.struct("score", (-F.col("cluster")).alias("low")))
    return scored.groupBy("row").agg(one.alias("one")).select("one.grp", "one.id", "one.cluster")


def merged_clusters(vectors: DataFrame, least: float, rows_of_range: int = RANGE, fan: int = FAN) -> DataFrame:
    """vectors: grp (string), id and v (an array). grp, id and cluster, the first id of its cluster; null vectors give no row."""
    known = vectors.filter("grp is not null and id is not null and v is not null").select("grp", "id", "v")
    # Ranges by hash would mix ids; by id they are neighbours, and a skewed id space only makes ranges of unequal size.
    dealt = written(known.select("*", F.floor(F.col("id") / rows_of_range).alias("part"), F.monotonically_increasing_id().alias("row")))

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = _unit(_matrix(pdf["v"]))
        return _table(pdf, _gathered(x, np.ones(len(x), np.int64), pdf["id"].to_numpy(np.int64), least))

    found = written(dealt.groupBy("grp", "part").applyInPandas(leaves, SUMMARY))
    while not found.groupBy("grp").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").isEmpty():
        found = _merged(found.withColumn("part", F.floor(F.col("part") / fan)).select(*_COLUMNS), least, rows_of_range)
    return _nearest(dealt, found, SPAN * rows_of_range)
