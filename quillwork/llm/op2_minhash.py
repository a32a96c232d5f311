"""Operator 2, MinHash near-dedup (method: signature-coordinate inverted join).

A text's set is its distinct 5-word shingles. Texts of equal sets are one class from the start.
A class is posted under each of its ``COORDINATES`` signature values, and two classes collide once
for each value they share. Classes linked at the threshold share at least ``needed`` values but for
a chance below ``MISS``. The joins that find them avoid most of the postings:

* skip: a value that one class alone holds can't collide, so a class with fewer than ``needed``
  other values is skipped at once, which is nearly every text without a near copy;
* prefix: with values in order of frequency, rarest first, two classes that share ``needed`` of
  them share one among all but the last ``needed`` - 1 of either, so only that prefix is joined;
* merge: the pivot of a posting list, its class of the most widely shared values, is compared with
  the list's others (a list of m gives m - 1 pairs, not m * m). Collisions are counted on both whole
  signatures, and pairs that match often enough are confirmed on their full sets;
* skip again: what is left are pairs of a list's members of which one at least is in another
  component than the pivot. Two sets as similar as asked share a shingle among the first quarter
  of either, in any order common to both. In the order that puts the shingles that many members
  hold last, a member far from the others has few of those in its quarter, so pairs that have no
  more in common than what all members have are never made; the rest are counted and confirmed.

Returned are components of confirmed links. A list of copies never makes all of its pairs.

Edge cases: a null or empty text, or one without a word, has an empty set and is linked with
nothing; a text of fewer than five words is one shingle; texts of any length count whole; repeated
rows and equal sets are linked; a null doc_id is linked as any other but can't be a component_id
unless the whole component has none; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm.common import documents, mapped, salted, slices, with_groups, written
from quillwork.llm.textscan import Words, mix

COORDINATES = 64
WORDS = 5
#: Similarity as a ratio of integers: 75 / 100.
SIMILARITY = (75, 100)
#: Chance that a pair at the threshold shares fewer values than ``needed``.
MISS = 1e-6
#: A shingle is common in a group if more than one in so many members has it.
COMMON = 4
SALTS = 16
#: A group of more members is dealt to SALTS tasks.
GROUP = 1024
_U = np.uint64
_FACTORS = np.random.Generator(np.random.PCG64(4242)).integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * _U(2) + _U(1)


def needed(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most matches that a pair of this similarity has but for a chance below ``miss``."""
    below, t = 0.0, 0
    while t < coordinates:
        below += comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if below > miss:
            break
        t += 1
    return max(1, t)


def shingles(texts: list[str]) -> list[np.ndarray]:
    """Each text's set as sorted 64-bit hashes."""
    hashes, bounds = Words(texts, lower=True).windows(WORDS)
    return [np.unique(hashes[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def signature(found: np.ndarray) -> np.ndarray:
    """One value a coordinate; values of different coordinates never meet."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for i in range(0, len(found), 4096):
        out = np.minimum(out, (_FACTORS[:, None] * found[None, i : i + 4096]).min(1))
    return mix(out + np.arange(COORDINATES, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """row (its place), doc_id, h (hash of the text), n_shingles, set_key (a digest of the set) and sig;
    the last two are null where there's no word."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sig", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            sets = shingles(texts)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            sigs = [signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in ("row", "doc_id", "h")), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, schema.field("sig").type)], schema=schema
            )

    ids = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("h"), "text")
    return mapped(ids, run, "row long, doc_id long, h long, n_shingles long, set_key binary, sig array<long>")


def postings(classes: DataFrame, need: int) -> DataFrame:
    """node, value, spread: each class's prefix, rarest value first, of classes that may have a link, and
    how many other classes hold its values in all."""
    posted = classes.select("node", F.explode("sig").alias("value"))
    shared = posted.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumnRenamed("value", "shared_value")
    common = posted.join(shared, F.col("value") == F.col("shared_value"))
    held = common.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("held"), F.sum("n").alias("spread")).filter(F.size("held") >= need)
    return held.select("node", "spread", F.explode(F.slice("held", F.lit(1), F.size("held") - (need - 1))).alias("post")).select("node", F.col("post.value").alias("value"), "spread")


def matches(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b and the signature values they share."""
    left = classes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    right = classes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    both = pairs.join(right, "b").join(left, "a")
    return both.select("a", "b", F.size(F.array_intersect("sig_a", "sig_b")).alias("matches"))


def full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and found, its full set, of these nodes. A class's text is found by doc_id and hash."""
    ids = nodes.join(classes.select("node", "holder"), "node").select("node", F.col("holder.doc_id").alias("node_doc"), F.col("holder.h").alias("node_h"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    schema = pa.schema([("node", pa.int64()), ("found", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, batch in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([s.tobytes() for s in shingles(batch)], pa.binary())], schema=schema)

    wanted = texts.join(ids.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("node_doc")) & (F.col("h") == F.col("node_h")))
    # Repeated rows hold one set.
    return mapped(wanted.select("node", "text"), run, "node long, found binary").dropDuplicates(["node"])


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs with set_a and set_b."""
    left = sets.select(F.col("node").alias("a"), F.col("found").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("found").alias("set_b"))
    return pairs.join(right, "b").join(left, "a")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    link = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    same, of = SIMILARITY

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(part.column("set_a"), part.column("set_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if of * both >= same * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], schema=link)

    return mapped(with_sets(pairs.select("a", "b"), sets).select("a", "b", "set_a", "set_b"), compare, "a long, b long")


def common_shingles(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members: g (group), b. For each g: its number of members m, shingles that over a share of 1 / COMMON of its members hold,
    rarest first (at most COMMON times a mean set), and the size of its smallest set."""
    schema = pa.schema([("g", pa.int64()), ("shingle", pa.int64())])
    held = members.join(sets.withColumnRenamed("node", "b"), "b").select("g", "m", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for start in range(0, rows.num_rows, 256):
                part = rows.slice(start, 256)
                found = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("found")]
                g = np.repeat(part.column("g").to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.concatenate(found))], schema=schema)

    counts = mapped(held.select("g", "found"), run, "g long, shingle long").groupBy("g", "shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = written(held.groupBy(F.col("g").alias("of"), "m").agg(F.min(F.octet_length("found") / 8).cast("int").alias("least")), "sizes")
    many, few, salt = salted(counts, sizes, F.col("shingle"), SALTS)
    counts = many.join(few.withColumnRenamed(salt, "of_salt"), (F.col("g") == F.col("of")) & (F.col(salt) == F.col("of_salt")))
    common = counts.filter(F.col("n") * COMMON > F.col("m")).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("c"))
    return sizes.join(common, F.col("g") == F.col("of"), "left").select("of", F.col("m").alias("of_m"), "least", F.coalesce("c.shingle", F.array().cast("array<long>")).alias("common"))


def first_quarter(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members: g (group), b, root and far (whether b is in another component than g). A row per
    shingle that b may share first with a similar set of its group, its place, and b's size."""
    schema = pa.schema([("g", pa.int64()), ("b", pa.int64()), ("root", pa.int64()), ("far", pa.bool_()), ("shingle", pa.int64()), ("place", pa.int32()), ("size", pa.int32())])
    same, of = SIMILARITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for start in range(0, rows.num_rows, 256):  # a few hundred sets' quarters at once
                part = rows.slice(start, 256)
                firsts = []
                for x, common, least in zip(part.column("found"), part.column("common"), part.column("least").to_pylist(), strict=True):
                    own, late = np.frombuffer(x.as_buffer(), np.int64), common.values.to_numpy()
                    n, late = len(own), late[np.isin(late, own)]
                    ordered = np.concatenate([own[~np.isin(own, late)], late])
                    # What it must share with the smallest set that can be similar.
                    share = max(-(-same * n // of), -(-same * (n + min(n, least)) // (of + same)))
                    firsts.append((ordered[: n - share + 1], n))
                times = np.array([len(q) for q, _ in firsts])
                kept = [pa.array(np.repeat(part.column(c).to_numpy(zero_copy_only=False), times), schema.field(c).type) for c in ("g", "b", "root", "far")]
                shingle = np.concatenate([q for q, _ in firsts])
                place = np.concatenate([np.arange(len(q), dtype=np.int32) for q, _ in firsts])
                size = np.repeat(np.array([n for _, n in firsts], np.int32), times)
                yield pa.RecordBatch.from_arrays([*kept, pa.array(shingle), pa.array(place), pa.array(size)], schema=schema)

    common = common_shingles(members, sets)
    # A group's shingles go once to each of its tasks, and only a large group has more than one.
    tasks = lambda m: F.when(F.col(m) > GROUP, SALTS).otherwise(1)
    few = common.select("of", "least", "common", F.explode(F.sequence(F.lit(0), tasks("of_m") - 1)).alias("of_salt"))
    many = members.withColumn("salt", F.pmod(F.xxhash64("b"), tasks("m")).cast("int"))
    held = many.join(few, (F.col("g") == F.col("of")) & (F.col("salt") == F.col("of_salt"))).join(sets.withColumnRenamed("node", "b"), "b")
    return mapped(held.select("g", "b", "root", "far", "found", "common", "least"), run, "g long, b long, root long, far boolean, shingle long, place int, size int")


def pairs_apart(star: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: pairs that may be similar enough of classes in one list, one of them at least apart from
    the list's pivot. Lists whose pivots are in one component are one group."""
    root = roots.select(F.col("node").alias("n2"), "root")
    known = star.join(root, F.col("b") == F.col("n2"), "left").select("a", "b", F.coalesce("root", "b").alias("root"))
    known = known.join(root.withColumnRenamed("root", "root_a"), F.col("a") == F.col("n2"), "left")
    known = known.select(F.coalesce("root_a", "a").alias("g"), "b", "root").distinct().withColumn("far", F.col("root") != F.col("g"))
    several = known.groupBy("g").agg(F.max("far").alias("any"), F.count(F.lit(1)).alias("n")).filter("any and n > 1").select(F.col("g").alias("open"), F.col("n").alias("m"))
    many, few, salt = salted(known, several, F.col("b"), SALTS)
    open_groups = many.join(few.withColumnRenamed(salt, "open_salt"), (F.col("g") == F.col("open")) & (F.col(salt) == F.col("open_salt")))
    members = written(open_groups.select("g", "b", "root", "far", "m"), "members")
    posts = written(first_quarter(members, sets), "quarters")
    left = posts.filter("far").select("g", "shingle", *[F.col(c).alias(f"u_{c}") for c in ("b", "root", "place", "size")])
    right = posts.select("g", "shingle", "far", *[F.col(c).alias(f"v_{c}") for c in ("b", "root", "place", "size")])
    same, of = SIMILARITY
    # What two sets may share from a common shingle on, against what they must share.
    enough = F.least(F.col("u_size") - F.col("u_place"), F.col("v_size") - F.col("v_place")) * (of + same) >= same * (F.col("u_size") + F.col("v_size"))
    once = (F.col("u_b") < F.col("v_b")) | (~F.col("far") & (F.col("u_b") != F.col("v_b")))
    both = left.join(right, ["g", "shingle"]).filter((F.col("u_root") != F.col("v_root")) & once & enough)
    return both.select(F.least("u_b", "v_b").alias("a"), F.greatest("u_b", "v_b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of every node with a link, by alternating large-star and
    small-star steps; each step is written, and the number of steps is logarithmic."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    # Edges are distinct, so two sets of them with one digest are the same.
    digest = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
    before = digest(edges)
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        # Large star: a node's larger neighbours are tied to its least neighbour.
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours are tied to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        joined = large.join(least, F.col("u") == F.col("k"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = written(small, "edges")
        now = digest(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_groups(docs: DataFrame) -> DataFrame:
    """A row per input row: row, doc_id, h, n_shingles, component_id, kept (doc_id is the component's) and
    kept_row, which of repeated rows of that doc_id holds for one."""
    need = needed(SIMILARITY[0] / SIMILARITY[1])
    sigs = written(signatures(docs), "signatures")
    held = sigs.filter("set_key is not null")
    nodes = written(held.groupBy("set_key").agg(F.min("row").alias("node"), F.min(F.struct("row", "doc_id", "h")).alias("holder"), F.min_by("sig", "row").alias("sig")), "classes")
    posts = written(postings(nodes, need), "postings")
    pivot = posts.groupBy("value").agg(F.max_by("node", F.struct("spread", "node")).alias("a"), F.count(F.lit(1)).alias("m")).filter("m > 1").withColumnRenamed("value", "list")
    star = posts.join(pivot, F.col("value") == F.col("list")).filter("a <> node").select("a", F.col("node").alias("b")).distinct()
    star = written(star, "star")
    sets = written(full_sets(star.select(F.col("a").alias("node")).union(star.select("b")).distinct(), nodes, docs), "sets")
    links = written(confirmed(matches(star, nodes).filter(F.col("matches") >= need), sets), "links")
    roots = components(links)
    more = written(matches(pairs_apart(star, roots, sets), nodes).filter(F.col("matches") >= need), "apart")
    if not more.isEmpty():
        links = links.union(written(confirmed(more, sets), "links"))
        roots = components(links)
    member = held.join(nodes.select("set_key", "node"), "set_key").select("row", "node")
    member = member.join(roots.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left").select(F.col("row").alias("r2"), F.coalesce("root", "node").alias("root"))
    rows = sigs.select("row", "doc_id", "h", "n_shingles").join(member, F.col("row") == F.col("r2"), "left").withColumn("root", F.coalesce("root", "row"))
    rows = written(rows.select("row", "doc_id", "h", "n_shingles", "root"), "members")
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"), F.count(F.lit(1)).alias("n"))
    several = written(least.filter("n > 1").withColumnRenamed("root", "r2"), "groups")
    joined = with_groups(rows, "root", several, "r2", "n", "row", GROUP, SALTS)
    component = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return joined.select("row", "doc_id", "h", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), (F.col("n").isNull() | (F.col("row") == F.col("least.row"))).alias("kept_row"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir)).drop("row", "h")
