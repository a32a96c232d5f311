"""Order-dependent consolidation: folds over the rows of one group, a group to a task.

Groups are conversations, reports or labels; of labels, which grow, rows are streamed. The folds depend on input order by definition, so they
aren't set operations; each sorts its group by an explicit key first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _overlap(a: set, b: set) -> float:
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def seed_groups(items: DataFrame, least: float) -> DataFrame:
    """Joins the first group whose seed resembles the item; roles aren't mixed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        seeds, out = [], []
        for turn, role, tokens in zip(pdf["turn"], pdf["role"], pdf["tokens"], strict=True):
            mine = set(tokens)
            found = next((g for g, r, s in seeds if r == role and _overlap(mine, s) >= least), None)
            if found is None:
                found = turn
                seeds.append((turn, role, mine))
            out.append(found)
        return pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"], "grp": out})

    return items.groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, grp long")


def online_centroids(vectors: DataFrame, least: float, bonus: float) -> DataFrame:
    """Joins the nearest running centre if near enough; the last cluster joined gets a bonus.

    The fold of a label is in order of vec_id, so one task does it, but rows stream through: of a label
    a worker holds the centres, not the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, sums, norms, n, last = object(), np.zeros((0, 0)), np.zeros(0), 0, -1
        for rows in batches:
            out = []
            for g, v in zip(rows.column("label").to_pylist(), rows.column("embedding").to_pylist(), strict=True):
                v = np.asarray(v, np.float64)
                if g != label:
                    label, sums, norms, n, last = g, np.zeros((8, len(v))), np.zeros(8), 0, -1
                size = np.linalg.norm(v)
                scores = sums[:n] @ v / np.where(norms[:n] * size > 0, norms[:n] * size, 1)
                scores[last : last + 1] += bonus if n else 0
                best = int(np.argmax(scores)) if n else -1
                if best < 0 or scores[best] < least:
                    if n == len(sums):  # room doubles
                        sums, norms = np.vstack([sums, np.zeros_like(sums)]), np.concatenate([norms, np.zeros_like(norms)])
                    best, n = n, n + 1
                sums[best] += v
                norms[best] = np.linalg.norm(sums[best])
                last = best
                out.append(best)
            yield pa.RecordBatch.from_arrays([rows.column("label"), rows.column("vec_id"), pa.array(out, pa.int64())], names=["label", "vec_id", "cluster"])

    dealt = vectors.select(F.col("label").cast("int"), F.col("vec_id").cast("long"), "embedding").repartition("label").sortWithinPartitions("label", "vec_id")
    return dealt.mapInArrow(run, "label int, vec_id long, cluster long")


def merge_by_distance(items: DataFrame, near: float, far: float, reach: int) -> DataFrame:
    """Merges an item into an earlier one at ``near`` within ``reach`` places, at ``far`` beyond; the
    item of more tokens stays, and tokens are pooled."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        kept: list[list] = []  # [turn of the fuller record, last turn, tokens, members]
        for turn, tokens in zip(pdf["turn"], pdf["tokens"], strict=True):
            mine = set(tokens)
            for k in kept:
                if _overlap(mine, k[2]) >= (near if turn - k[1] <= reach else far):
                    if len(mine) > len(k[2]):
                        k[0] = turn
                    k[1], k[2] = turn, k[2] | mine
                    k[3].append(turn)
                    break
            else:
                kept.append([turn, turn, mine, [turn]])
        rows = [(int(pdf["conv_id"].iloc[0]), int(k[0]), len(k[3]), ",".join(map(str, k[3]))) for k in kept]
        return pd.DataFrame(rows, columns=["conv_id", "survivor", "n", "members"])

    return items.groupBy("conv_id").applyInPandas(run, "conv_id long, survivor long, n long, members string")


def gap_families(events: DataFrame, keys: list[str], order: list[str], gap_seconds: int) -> DataFrame:
    """Runs of a key's rows with no gap above the limit, and their sizes."""
    w = Window.partitionBy(*keys).orderBy(*order)
    at = F.col(order[0]).cast("timestamp").cast("double")
    new = F.when(at - F.lag(at).over(w) <= gap_seconds, 0).otherwise(1)
    marked = events.withColumn("new", new).withColumn("family", F.sum("new").over(w))
    return marked.groupBy(*keys, "family").agg(F.count(F.lit(1)).alias("n"))
