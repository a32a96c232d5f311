"""Vector search: exact by blocks, and a coarse-celled index (an inverted file as columns)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.operators.components import written
from quillwork.operators.latest import ranked

#: Rows that centres are fitted on at most.
FIT_ROWS = 5000
#: Rows of the index for which each cell has one task more, and those for which its queries have.
CELL_ROWS, TURN_ROWS = 1 << 17, 1 << 19
#: Scores that a task makes at once, and pairs that it scores component by component at once.
SCORES, EXACT = 1 << 21, 1 << 15
#: Vectors of a block: a product of two blocks is of 1024 by 2048 scores.
ASKED_BLOCK, ROWS_BLOCK = 1024, 2048
#: Blocks of either side whose pairs are a task's.
TASK_BLOCKS = 4
#: Queries whose best rows a task holds before it hands them on.
HELD_ASKED = 1 << 16


def centroids(vectors: DataFrame, k: int, steps: int = 8) -> np.ndarray:
    """k centres by spherical k-means on a bounded sample: the FIT_ROWS rows of the least id hash."""
    rows = vectors.select("embedding", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(FIT_ROWS).collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = x[:: max(1, len(x) // k)][:k].copy()
    for _ in range(steps):
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def cells(vectors: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """Each row once for each of its n nearest cells."""

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), np.float64)
        return pd.Series(list((-(x @ centres.T)).argsort(1, kind="stable")[:, :n].astype(np.int32)))

    return vectors.select("vec_id", "embedding", F.explode(nearest("embedding")).alias("cell"))


def best_in_cells(asked: DataFrame, index: DataFrame, rows: int, k: int) -> DataFrame:
    """q, vec_id and score of the k best index rows in the cells that a query looks into, of each task: a cell's rows are
    dealt to as many tasks as ``rows``, the size of the whole index, asks for, and so are its queries, so what meets in
    one task doesn't grow. A task scores them as products of matrices; what may be among the k best is scored again,
    component by component."""
    tasks, turns = max(1, -(-rows // CELL_ROWS)), max(1, -(-rows // TURN_ROWS))
    one_of = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    r = index.withColumn("part", one_of(tasks)).withColumn("turn", each(turns))
    q = asked.withColumn("turn", one_of(turns)).withColumn("part", each(tasks))

    def run(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(ours) and len(theirs):
            ids, x = ours["vec_id"].to_numpy(np.int64), np.array(ours["embedding"].tolist(), np.float64)
            size = np.linalg.norm(x, axis=1).max()
            step = max(1, SCORES // len(x))
            for at in range(0, len(theirs), step):
                some = theirs.iloc[at : at + step]
                v = np.array(some["embedding"].tolist(), np.float64)
                scores = v @ x.T
                if len(x) > k:  # a product's rounding depends on its shape: whatever is this near stays in
                    least = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k] - 1e-12 * size * np.linalg.norm(v, axis=1)
                    i, j = np.nonzero(scores >= least[:, None])
                else:
                    i, j = (g.ravel() for g in np.indices(scores.shape))
                exact = np.concatenate([np.cumsum(v[i[a : a + EXACT]] * x[j[a : a + EXACT]], axis=1)[:, -1] for a in range(0, len(i), EXACT)])
                order = np.lexsort((ids[j], -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                few = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append(pd.DataFrame({"q": some["vec_id"].to_numpy(np.int64)[i[few]], "vec_id": ids[j[few]], "score": exact[few]}))
        return pd.concat(out)

    keys = ["cell", "part", "turn"]
    return r.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(run, "q long, vec_id long, score double")


def blocks(vectors: DataFrame, most: int, prefix: str) -> DataFrame:
    """Rows of up to ``most`` vectors of one partition and one size: ids, their matrix, and that size."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple]] = {}

        def block(size: int) -> pd.DataFrame:
            ids, rows = zip(*held.pop(size), strict=True)
            return pd.DataFrame({f"{prefix}_ids": [np.array(ids, np.int64).tobytes()], f"{prefix}_matrix": [np.array(rows, np.float64).tobytes()], f"{prefix}_size": [size]})

        for pdf in frames:
            for i, v in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= most:
                    yield block(len(v))
        for size in list(held):
            yield block(size)

    known = vectors.filter("vec_id is not null and size(embedding) > 0").select("vec_id", "embedding")
    return known.mapInPandas(run, f"{prefix}_ids binary, {prefix}_matrix binary, {prefix}_size int")


def block_pairs(asked: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every query block beside every row block. Spark hands a task's rows to Python many at a time and a pair has two
    matrices, so a task has the pairs of a few blocks of either side, however many there are."""
    r, q = (written(blocks(df.select("vec_id", "embedding"), most, x)) for df, most, x in ((vectors, ROWS_BLOCK, "r"), (asked.repartition(max(1, -(-asked.count() // ASKED_BLOCK))), ASKED_BLOCK, "q")))
    return dealt(r, "r_ids").crossJoin(dealt(q, "q_ids").hint("shuffle_replicate_nl"))


def dealt(made: DataFrame, key: str) -> DataFrame:
    """Blocks in partitions of ``TASK_BLOCKS``, in the order of their first bytes."""
    return made.repartitionByRange(max(1, -(-made.count() // TASK_BLOCKS)), F.xxhash64(key))


def best_rows(asked: DataFrame, vectors: DataFrame, k: int, digits: int = 4) -> DataFrame:
    """q, vec_id and score of the k best rows of ``vectors`` for each row of ``asked``, exact: every
    query block meets every row block, and a task hands on the k best of what it saw. The order is by
    the rounded score, then by vec_id."""
    pairs = block_pairs(asked, vectors)

    def best(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best columns of each row."""
        if scores.shape[1] > 4 * k:  # whatever ties with the k-th best stays in
            least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            at = [np.flatnonzero(row >= m) for row, m in zip(scores, least, strict=True)]
        else:
            at = [np.arange(scores.shape[1])] * len(scores)
        at = np.stack([a[np.lexsort((i[a], -row[a]))][:k] for a, i, row in zip(at, ids, scores, strict=True)])
        return np.take_along_axis(ids, at, 1), np.take_along_axis(scores, at, 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def hand_on() -> Iterator[pd.DataFrame]:
            for q_ids, (ids, scores) in held.items():
                yield pd.DataFrame({"q": np.repeat(np.frombuffer(q_ids, np.int64), ids.shape[1]), "vec_id": ids.ravel(), "score": scores.ravel()})
            held.clear()

        for pdf in frames:
            for r_ids, r, size, q_ids, q, q_size in zip(*(pdf[c] for c in pdf.columns), strict=True):
                if size != q_size:  # told here: as a join condition, one size would be the only key
                    continue
                exact = np.frombuffer(q, np.float64).reshape(-1, size) @ np.frombuffer(r, np.float64).reshape(-1, size).T
                scores = np.copysign(np.floor(np.abs(exact) * 10**digits + 0.5), exact) / 10**digits + 0.0
                ids = np.broadcast_to(np.frombuffer(r_ids, np.int64), scores.shape)
                found = best(ids, scores)
                if q_ids in held:
                    found = best(*(np.concatenate(x, axis=1) for x in zip(held[q_ids], found, strict=True)))
                held[q_ids] = found
                if 8 * HELD_ASKED < sum(map(len, held)):
                    yield from hand_on()
        yield from hand_on()

    scored = pairs.mapInPandas(run, "q long, vec_id long, score double")
    return ranked(scored, ["q"], [F.desc("score"), F.col("vec_id")]).filter(F.col("place") <= k).select("q", "vec_id", "score")


def rows_above(asked: DataFrame, vectors: DataFrame, least: float, digits: int = 4) -> DataFrame:
    """q, vec_id and score of all rows of ``vectors`` whose rounded score with a row of ``asked`` is ``least``
    or more, exact: every query block meets every row block."""
    pairs = block_pairs(asked, vectors)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r_ids, r, size, q_ids, q, q_size in zip(*(pdf[c] for c in pdf.columns), strict=True):
                if size != q_size:
                    continue
                exact = np.frombuffer(q, np.float64).reshape(-1, size) @ np.frombuffer(r, np.float64).reshape(-1, size).T
                scores = np.copysign(np.floor(np.abs(exact) * 10**digits + 0.5), exact) / 10**digits + 0.0
                i, j = np.nonzero(scores >= least)
                yield pd.DataFrame({"q": np.frombuffer(q_ids, np.int64)[i], "vec_id": np.frombuffer(r_ids, np.int64)[j], "score": scores[i, j]})

    return pairs.mapInPandas(run, "q long, vec_id long, score double")
