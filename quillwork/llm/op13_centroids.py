"""Operator 13, centroid clustering (method: annulus search).

Vectors become integers, so every distance, sum and tie is exact. Centroids are sorted by norm. The
distance from a vector to the centroid whose norm is next to its own is an upper bound of its least
distance; by the triangle inequality only centroids whose norm is within that bound of the vector's
norm can be as near, and two binary searches find them. They alone are compared, those on the
annulus's edge too, and the smallest number wins a tie.

A round reads the vectors once: each task adds up its vectors by cluster and sends a row for each
cluster and component, which Spark sums. The driver holds the centroids, k times the dimension numbers,
however many vectors there are. A hot cluster is many tasks' partial sums.

Kept are vectors of exactly the dimension without a null, NaN or infinite component; others give no row.
Edge cases: repeated rows each give a row, and centroids that start equal keep their order, the later
ones staying empty; a null vec_id counts as no digits; fewer vectors than k give as many centroids; an
empty table gives no row; components beyond 2**26 are computed with Python's integers, and a distance
beyond a long is given as the largest long; further input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm.common import mapped, written

DIMENSION, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Components of at most this size have sums of squares, over up to 1024 dimensions, that a long and a double hold well.
SAFE = 1 << 26
MOST = (1 << 63) - 1
#: Sums that no long holds go as digits to this base.
LIMB = 10**18
#: Vectors looked at at once.
ROWS = 4096


def integers(vectors: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the components times ``scale`` rounded down, of the vectors that are kept: q is the
    components as decimal numbers, so that none is too large, where one exceeds SAFE."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(F.size("x") == dimension)
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform("x", lambda v: F.floor(v * scale))
    safe = F.forall("x", lambda v: F.abs(v * scale) < SAFE)
    return rows.filter(finite).select("vec_id", F.when(safe, q).alias("q"), F.when(~safe, F.col("x")).alias("x"))


def exact(x: list[float], scale: int = SCALE) -> list[int]:
    """Components beyond SAFE, without loss: a double is a fraction of integers."""
    return [a * scale // b for a, b in (v.as_integer_ratio() for v in x)]


class Annuli:
    """Centroids by norm, and the search of vectors' nearest."""

    def __init__(self, centroids: list[tuple[int, ...]]):
        self.big = any(abs(v) >= SAFE for c in centroids for v in c)
        self.plain = centroids
        c = np.array(centroids, object if self.big else np.int64)
        squares = np.array([float(sum(v * v for v in row)) for row in centroids])
        self.order = np.argsort(squares, kind="stable")
        self.norms = np.sqrt(squares[self.order])
        self.sorted = c[self.order]
        #: Candidates looked at so far, beside the first one of each vector.
        self.compared = 0

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each vector's nearest centroid; q: integers within SAFE."""
        if self.big:
            found = [self.nearest_exact(row) for row in q.tolist()]
            return np.array([k for k, _ in found], np.int64), np.array([min(d, MOST) for _, d in found], np.int64)
        n, k = len(q), len(self.order)
        norm = np.sqrt(np.einsum("ij,ij->i", q, q).astype(np.float64))
        at = np.minimum(np.searchsorted(self.norms, norm), k - 1)
        below = np.maximum(at - 1, 0)
        at = np.where(norm - self.norms[below] < self.norms[at] - norm, below, at)
        gap = q - self.sorted[at]
        best = np.einsum("ij,ij->i", gap, gap)
        number = self.order[at].copy()
        # Square roots are rounded: the annulus is widened by more than their error, and the exact comparison decides.
        widened = lambda d, norm: np.sqrt(d.astype(np.float64)) * (1 + 1e-12) + (norm + 1) * 1e-12
        bound = widened(best, norm)
        low, high = np.searchsorted(self.norms, norm - bound, "left"), np.searchsorted(self.norms, norm + bound, "right")
        # From the vector's own norm outwards: a nearer centroid narrows the annulus for those that follow.
        for step in range(1, int(np.maximum(at - low, high - 1 - at).max()) + 1 if n else 0):
            for place in (at - step, at + step):
                rows = np.flatnonzero((place >= low) & (place < high))
                rows = rows[np.abs(self.norms[place[rows]] - norm[rows]) <= bound[rows]]
                self.compared += len(rows)
                other = place[rows]
                gap = q[rows] - self.sorted[other]
                d, name = np.einsum("ij,ij->i", gap, gap), self.order[other]
                wins = (d < best[rows]) | ((d == best[rows]) & (name < number[rows]))
                rows = rows[wins]
                best[rows], number[rows] = d[wins], name[wins]
                bound[rows] = widened(best[rows], norm[rows])
        return number, best

    def nearest_exact(self, q: list[int]) -> tuple[int, int]:
        """The same for a vector beyond SAFE."""
        d, k = min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), k) for k, c in enumerate(self.plain))
        return k, d


def limbs(x: int) -> list[int]:
    """Digits of a whole number to the base LIMB, the lowest first, with its sign: sums of them are sums of numbers."""
    out, sign, x = [], -1 if x < 0 else 1, abs(x)
    while x or not out:
        x, low = divmod(x, LIMB)
        out.append(sign * low)
    return out


def matrices(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[list[int]]]]:
    """(rows, vectors within SAFE, the others): a batch's rows within SAFE come before its others."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            safe = part.column("q").is_valid()
            rows = pa.concat_batches([part.filter(safe), part.filter(part.column("q").is_null())])
            q = part.filter(safe).column("q")
            values = q.flatten().to_numpy(zero_copy_only=False)
            others = [exact(x, scale) for x in part.filter(part.column("q").is_null()).column("x").to_pylist()]
            yield rows, values.reshape(len(q), -1) if len(q) else np.zeros((0, 1), np.int64), others


def sums(vectors: DataFrame, centroids: list[tuple[int, ...]], scale: int = SCALE) -> dict[int, tuple[int, list[int]]]:
    """cluster: (its vectors, their sums by component). A task sends a row for each cluster and component."""
    dimension = len(centroids[0])
    ddl = "cluster int, component int, limb int, n long, total long"
    schema = pa.schema([("cluster", pa.int32()), ("component", pa.int32()), ("limb", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annuli(centroids)
        n, total = [0] * len(centroids), [[0] * dimension for _ in centroids]
        for _, q, others in matrices(batches, scale):
            number = search.nearest(q)[0] if len(q) else np.zeros(0, np.int64)
            found = [search.nearest_exact(x)[0] for x in others]
            for k in range(len(centroids)):
                mine = q[number == k]
                far = [x for x, c in zip(others, found, strict=True) if c == k]
                n[k] += len(mine) + len(far)
                if len(mine):
                    total[k] = [a + b for a, b in zip(total[k], mine.sum(axis=0).tolist(), strict=True)]
                for x in far:
                    total[k] = [a + b for a, b in zip(total[k], x, strict=True)]
        rows = [(k, j, i, n[k], x) for k in range(len(centroids)) if n[k] for j in range(dimension) for i, x in enumerate(limbs(total[k][j]))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    added = mapped(vectors, run, ddl).groupBy("cluster", "component", "limb").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in added.orderBy("cluster", "component", "limb").collect():  # k times the dimension rows, and more only beyond SAFE
        _, total = out.setdefault(r["cluster"], (r["n"], [0] * dimension))
        total[r["component"]] += int(r["total"]) * LIMB ** r["limb"]
    return out


def first_centroids(vectors: DataFrame, k: int, salt: str, scale: int = SCALE) -> list[tuple[int, ...]]:
    """The k vectors whose numbers have the smallest hashes, in the order of these."""
    name = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(name.alias("name"), "q", "x").orderBy("name", "q", "x").limit(k).collect()  # k rows
    return [tuple(r["q"]) if r["q"] is not None else tuple(exact(r["x"], scale)) for r in rows]


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = "3:", dimension: int = DIMENSION, scale: int = SCALE) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """(vec_id, cluster, distance of each vector that is kept; the centroids)."""
    kept = written(integers(vectors, dimension, scale), "vectors")
    centroids = first_centroids(kept, k, salt, scale)
    if not centroids:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        found = sums(kept, centroids, scale)
        centroids = [tuple(t // found[i][0] for t in found[i][1]) if i in found else c for i, c in enumerate(centroids)]

    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annuli(centroids)
        for rows, q, others in matrices(batches, scale):
            number, best = search.nearest(q) if len(q) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            far = [search.nearest_exact(x) for x in others]
            cluster = pa.array([*number.tolist(), *(k for k, _ in far)], pa.int32())
            distance = pa.array([*best.tolist(), *(min(d, MOST) for _, d in far)], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), cluster, distance], schema=schema)

    return mapped(kept, run, "vec_id long, cluster int, distance long"), centroids


def name_of(centroid: tuple[int, ...]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = written(found, "assigned")
    parts = {r["cluster"]: int(r["part"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part")).collect()}  # k rows
    whole = min(sum(parts.values()), MOST)
    told = [(i, min(d, MOST), whole, name_of(centroids[i])) for i, d in parts.items()]
    # A row for each centroid, so k at most.
    by = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(by), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The same rows: each round is two steps over the vectors, with all distances."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSION})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS k, q FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM v ORDER BY h, q LIMIT {CENTROIDS}) AS s)",
    ]
    near = """a{i} AS MATERIALIZED (SELECT r, arg_min(k, d * 64 + k) AS k, min(d) AS d FROM (SELECT v.r, c.k, CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{i} AS c) AS s GROUP BY r)"""
    for i in range(ROUNDS):
        steps += [
            near.replace("{i}", str(i)),
            f"""m{i} AS MATERIALIZED (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS q FROM (SELECT a.k, j.j, sum(v.q[j.j]) AS s, count(*) AS n FROM v JOIN a{i} AS a USING (r), range(1, {DIMENSION + 1}) AS j(j) GROUP BY a.k, j.j) AS s GROUP BY k)""",
            f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{i} AS c LEFT JOIN m{i} AS m USING (k))",
        ]
    steps.append(near.replace("{i}", str(ROUNDS)))
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT v.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM v JOIN a{ROUNDS} AS a USING (r) JOIN c{ROUNDS} AS c USING (k)"""
    )


ORACLE = _oracle()
