"""An index of vectors that grows with them: two levels of cells, and short codes in the lists.

With n rows there are about n ** (1/4) coarse cells, each split into as many fine ones, so cells grow with the
square root of rows and a list does too. Coarse centres are trained on all rows, in steps whose partial sums are all that
moves; the fine ones of a coarse cell on a bounded sample of its rows (``FIT_ROWS``, those of the least hash), cell by cell
where its rows are. A row is kept in the list of its fine cell as its residual there, a byte a component. Every row is
indexed, once.

A query ranks the fine cells by their centres, looks through the codes of the best ones, and only ``scored`` rows of the
best approximate scores are fetched and scored exactly. Lists are cut into blocks, so a large cell is many tasks'; a block
meets all queries that look into its cell as one product of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions.vectors import dot
from quillwork.operators.components import written
from quillwork.operators.latest import ranked

FIT_ROWS, STEPS = 4096, 6
#: Rows of a block of a list, queries that meet it at once, and queries whose cells a task ranks at once.
LIST_ROWS, ASKED_ROWS = 8192, 512


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _steps(x: np.ndarray, k: int) -> np.ndarray:
    """k centres or as many as there are rows, by spherical k-means of rows at hand."""
    c = _unit(x[:: max(1, len(x) // k)][:k])
    for _ in range(STEPS):
        near = (_unit(x) @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, _unit(x))
        c = _unit(np.where(np.bincount(near, minlength=len(c))[:, None] > 0, total, c))
    return c


@dataclass
class Index:
    coarse: np.ndarray
    #: coarse, fine and centre of each fine cell.
    fine: DataFrame
    #: coarse, fine, ids, codes and scales of each block of a list.
    lists: DataFrame
    rows: int


def _coarse(vectors: DataFrame, k: int) -> np.ndarray:
    """k centres trained on all rows: each step is one pass whose tasks hand on a sum for each centre."""
    first = vectors.select("embedding", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(k).collect()  # k rows
    centres = _unit(np.array([r["embedding"] for r in first], np.float64))
    for _ in range(STEPS):

        def run(frames: Iterator[pd.DataFrame], c: np.ndarray = centres) -> Iterator[pd.DataFrame]:
            total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
            for pdf in frames:
                x = _unit(np.array(pdf["embedding"].tolist(), np.float64))
                near = (x @ c.T).argmax(1)
                np.add.at(total, near, x)
                n += np.bincount(near, minlength=len(c))
            yield pd.DataFrame({"cell": np.repeat(np.flatnonzero(n), c.shape[1]), "i": np.tile(np.arange(c.shape[1]), int((n > 0).sum())), "x": total[n > 0].ravel()})

        sums = vectors.select("embedding").mapInPandas(run, "cell long, i long, x double").groupBy("cell", "i").agg(F.sum("x").alias("x")).collect()  # k times the dimension
        new = np.zeros_like(centres)
        for r in sums:
            new[r["cell"], r["i"]] = r["x"]
        centres = _unit(np.where(np.abs(new).sum(1, keepdims=True) > 0, new, centres))
    return centres


def build(vectors: DataFrame) -> Index:
    """vectors: vec_id and embedding, all of one dimension; rows without either are left out."""
    known = written(vectors.filter("vec_id is not null and size(embedding) > 0").select("vec_id", "embedding"))
    n = known.count()
    k = max(1, round(n**0.25))
    centres = _coarse(known, k) if n else np.zeros((0, 1))

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x = np.array(pdf["embedding"].tolist(), np.float64)
            yield pdf.assign(coarse=(_unit(x) @ centres.T).argmax(1))

    rows = written(known.mapInPandas(placed, "vec_id long, embedding array<double>, coarse long"))
    # A bounded sample of each coarse cell: rows of the least hash, of a share that gives about FIT_ROWS of an even cell, then cut.
    share = min(1.0, 2.0 * FIT_ROWS * k / max(n, 1))
    sample = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = ranked(sample, ["coarse"], [F.xxhash64("vec_id"), F.col("vec_id")]).filter(F.col("place") <= FIT_ROWS)

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        c = _steps(np.array(pdf.sort_values("place")["embedding"].tolist(), np.float64), k)
        return pd.DataFrame({"coarse": int(pdf["coarse"].iloc[0]), "fine": np.arange(len(c)), "centre": c.tolist()})

    fine = written(sample.groupBy("coarse").applyInPandas(split, "coarse long, fine long, centre array<double>"))
    matrices = fine.groupBy("coarse").agg(F.sort_array(F.collect_list(F.struct("fine", "centre"))).alias("cells"))  # k centres a row
    parts = max(1, -(-n // (LIST_ROWS * k)))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
    with_cells = matrices.withColumnRenamed("coarse", "of").withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def listed(pdf: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf) and len(cells):
            c = np.array([x["centre"] for x in cells["cells"].iloc[0]], np.float64)
            pdf = pdf.sort_values("vec_id")
            x, ids = np.array(pdf["embedding"].tolist(), np.float64), pdf["vec_id"].to_numpy(np.int64)
            near = (_unit(x) @ c.T).argmax(1)
            rest = x - c[near]
            scale = np.maximum(np.abs(rest).max(1), 1e-12) / 127
            codes = np.rint(rest / scale[:, None]).astype(np.int8)
            for f in np.unique(near):
                mine = np.flatnonzero(near == f)
                for at in range(0, len(mine), LIST_ROWS):
                    m = mine[at : at + LIST_ROWS]
                    out.append((int(pdf["coarse"].iloc[0]), int(f), ids[m].tobytes(), codes[m].tobytes(), scale[m].tobytes()))
        return pd.DataFrame(out, columns=["coarse", "fine", "ids", "codes", "scales"])

    lists = dealt.groupBy("coarse", "part").cogroup(with_cells.groupBy("of", "at")).applyInPandas(listed, "coarse long, fine long, ids binary, codes binary, scales binary")
    return Index(centres, fine, written(lists), n)


def search(index: Index, asked: DataFrame, vectors: DataFrame, k: int, looked: float = 0.7, scored: int = 40) -> tuple[DataFrame, DataFrame]:
    """asked: vec_id and embedding. q, vec_id and score of about the k best rows of each, and the pairs that were scored
    exactly. ``looked`` is the share of the rows whose codes are looked through."""
    q = written(asked.filter("vec_id is not null and size(embedding) > 0").select(F.col("vec_id").alias("q"), F.col("embedding").cast("array<double>").alias("v")))
    sizes = index.lists.groupBy("coarse", "fine").agg(F.sum(F.octet_length("ids") / 8).alias("n"))
    # A list of cells, as long as the square root of the rows: it goes to each task that ranks cells.
    cells = index.fine.join(sizes, ["coarse", "fine"]).select("coarse", "fine", "centre", "n")
    table = cells.agg(F.sort_array(F.collect_list(F.struct("coarse", "fine", "centre", "n"))).alias("cells"))
    enough = looked * index.rows

    def cells_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = None
        for pdf in frames:
            if c is None:
                rows = pdf["cells"].iloc[0]
                names, n = [(r["coarse"], r["fine"]) for r in rows], np.array([r["n"] for r in rows])
                c = np.array([r["centre"] for r in rows], np.float64)
            for start in range(0, len(pdf), ASKED_ROWS):
                part = pdf.iloc[start : start + ASKED_ROWS]
                x = np.array(part["v"].tolist(), np.float64)
                order = np.argsort(-(x @ c.T), axis=1, kind="stable")
                upto = np.cumsum(n[order], axis=1) - n[order]
                out = [(i, *names[j]) for i, o, u in zip(part["q"], order, upto, strict=True) for j in o[u < enough]]
                yield pd.DataFrame(out, columns=["q", "coarse", "fine"])

    ranked_cells = q.crossJoin(F.broadcast(table)).mapInPandas(cells_of, "q long, coarse long, fine long")
    block = F.pmod(F.xxhash64("q"), F.lit(max(1, q.count() // ASKED_ROWS))).alias("block")
    meets = ranked_cells.join(q, "q").groupBy("coarse", "fine", block).agg(F.collect_list(F.struct("q", "v")).alias("asked"))
    pairs = index.lists.join(meets, ["coarse", "fine"]).join(index.fine, ["coarse", "fine"]).select("ids", "codes", "scales", "centre", "asked")

    def looked_through(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for ids, codes, scales, centre, those in zip(*(pdf[c] for c in pdf.columns), strict=True):
                ids, scales, centre = np.frombuffer(ids, np.int64), np.frombuffer(scales), np.asarray(centre, np.float64)
                x = np.frombuffer(codes, np.int8).reshape(len(ids), -1) * scales[:, None] + centre
                scores = np.array([a["v"] for a in those], np.float64) @ x.T
                for a, row in zip(those, scores, strict=True):
                    best = np.argsort(-row, kind="stable")[:scored]
                    yield pd.DataFrame({"q": a["q"], "vec_id": ids[best], "near": row[best]})

    near = pairs.mapInPandas(looked_through, "q long, vec_id long, near double")
    few = written(ranked(near, ["q"], [F.desc("near"), F.col("vec_id")]).filter(F.col("place") <= scored).select("q", "vec_id"))
    exact = few.join(vectors.select("vec_id", "embedding"), "vec_id").join(q, "q").select("q", "vec_id", F.round(dot(F.col("v"), F.col("embedding")), 4).alias("score"))
    return ranked(exact, ["q"], [F.desc("score"), F.col("vec_id")]).filter(F.col("place") <= k).select("q", "vec_id", "score"), few
