"""Lexical similarity and fuzzy matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.fuzzy import partial_ratio, token_set_ratio
from quillwork.functions.text import ascii_only, jaccard, overlap, overlap_of_larger, stem, words
from quillwork.operators.latest import ranked
from quillwork.operators.matching import left_out, nearest_names, pairs_sharing
from quillwork.plans.book import Book
from quillwork.sources.tables import Tables

queries = Book()


def _next_turn(t: Tables, least: int = 3) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    distinct = F.array_distinct(words(F.col("text"), least))
    return t.conversations.select("conv_id", "turn", distinct.alias("a"), F.lead(distinct).over(w).alias("b")).filter("b is not null")


_PAIRS = """WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS a FROM conversations), p AS (SELECT conv_id, turn, a, lead(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w),
q AS (SELECT conv_id, turn, len(list_intersect(a, b)) AS s, len(a) AS na, len(b) AS nb FROM p WHERE b IS NOT NULL) """


@queries("K1 K4 K5 V20", _PAIRS + """SELECT conv_id, turn, CASE WHEN least(na, nb) > 0 THEN round(s / least(na, nb), 4) ELSE 0 END AS overlap, CASE WHEN greatest(na, nb) > 0 THEN round(s / greatest(na, nb), 4) ELSE 1 END AS of_larger, CASE WHEN na + nb - s > 0 THEN round(s / (na + nb - s), 4) ELSE 0 END AS jaccard FROM q""")
def turn_overlaps(t: Tables) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _next_turn(t).select("conv_id", "turn", F.round(overlap(a, b), 4).alias("overlap"), F.round(overlap_of_larger(a, b), 4).alias("of_larger"), F.round(jaccard(a, b), 4).alias("jaccard"))


_STEM = "list_distinct(list_transform({x}, lambda w: regexp_replace(w, '^([a-z0-9]{{3,}}?)(?:ing|ed|es|s)$', '\\1')))"


@queries("K2", f"""{_PAIRS}, st AS (SELECT conv_id, turn, {_STEM.format(x='a')} AS a, {_STEM.format(x='b')} AS b FROM p WHERE b IS NOT NULL) SELECT conv_id, turn, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0 END, 4) AS score FROM st""")
def stemmed_overlap(t: Tables) -> DataFrame:
    stems = lambda c: F.array_distinct(F.transform(F.col(c), stem))
    return _next_turn(t).select("conv_id", "turn", F.round(overlap(stems("a"), stems("b")), 4).alias("score"))


@queries("K6", r"""WITH n AS (SELECT regexp_replace(p_name, '[^\x00-\x7F]', '', 'g') AS name, count(*) AS parts FROM part GROUP BY 1) SELECT a.name AS a, b.name AS b, levenshtein(a.name, b.name) AS distance, a.parts * b.parts AS pairs FROM n a JOIN n b ON a.name < b.name WHERE levenshtein(a.name, b.name) <= 2""")
def close_distinct_names(t: Tables) -> DataFrame:
    """All pairs of distinct names within two edits: both have a variant with up to two letters left out in
    common, so only such pairs are compared; and how many pairs of parts bear them."""
    names = t.part.groupBy(ascii_only(F.col("p_name")).alias("name")).agg(F.count(F.lit(1)).alias("parts"))
    posted = names.select("name", "parts", F.explode(left_out("name", 2)).alias("variant"))
    a = posted.select("variant", F.col("name").alias("a"), F.col("parts").alias("n_a"))
    b = posted.select("variant", F.col("name").alias("b"), F.col("parts").alias("n_b"))
    pairs = a.join(b, "variant").filter("a < b").select("a", "b", (F.col("n_a") * F.col("n_b")).alias("pairs")).distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b", 2)).filter("distance >= 0").select("a", "b", "distance", "pairs")


@queries("K7 K10 K11")
def nearest_supplier_name(t: Tables) -> DataFrame:
    """Misspelt names (two letters swapped) resolved to the one supplier within the allowed distance."""
    n = F.length("s_name")
    swapped = F.concat(F.substr("s_name", F.lit(1), n - 2), F.substr("s_name", n, F.lit(1)), F.substr("s_name", n - 1, F.lit(1)))
    return nearest_names(t.supplier.select(F.col("s_suppkey").alias("asked"), swapped.alias("said")), t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


#: Keys of a range in which the next part of a brand is looked for; across ranges it is the first of the next one.
KEY_RANGE = 1 << 16


@queries("K8 V4")
def fuzzy_ratios(t: Tables) -> DataFrame:
    """Likeness of each part's name to the next one's of its brand; a brand is as many tasks as it has ranges of keys."""
    p = t.part.select("p_brand", "p_partkey", "p_name", F.floor(F.col("p_partkey") / KEY_RANGE).alias("range"))
    firsts = p.groupBy("p_brand", "range").agg(F.min_by("p_name", "p_partkey").alias("first"))
    after = firsts.select("p_brand", "range", F.lead("first").over(Window.partitionBy("p_brand").orderBy("range")).alias("first_after"))  # one row a range
    inside = F.lead("p_name").over(Window.partitionBy("p_brand", "range").orderBy("p_partkey"))
    both = p.withColumn("inside", inside).join(after, ["p_brand", "range"]).withColumn("other", F.coalesce("inside", "first_after")).filter("other is not null")
    return both.select("p_partkey", token_set_ratio("p_name", "other").alias("token_set"), partial_ratio("p_name", "other").alias("partial"))


@queries("K9", """WITH f AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM conversations), tf AS (SELECT conv_id, turn, tok, count(*) AS n FROM f GROUP BY 1, 2, 3), nm AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS norm FROM tf GROUP BY 1, 2)
SELECT a.conv_id, a.turn, round(sum(a.n * b.n) / (any_value(x.norm) * any_value(y.norm)), 4) AS cosine FROM tf a JOIN tf b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.tok = b.tok JOIN nm x ON x.conv_id = a.conv_id AND x.turn = a.turn JOIN nm y ON y.conv_id = b.conv_id AND y.turn = b.turn GROUP BY a.conv_id, a.turn""")
def term_cosine(t: Tables) -> DataFrame:
    tf = t.conversations.select("conv_id", "turn", F.explode(words(F.col("text"))).alias("tok")).groupBy("conv_id", "turn", "tok").agg(F.count(F.lit(1)).alias("n"))
    norm = tf.groupBy("conv_id", "turn").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    after = tf.select("conv_id", (F.col("turn") - 1).alias("turn"), "tok", F.col("n").alias("m"))
    dot = tf.join(after, ["conv_id", "turn", "tok"]).groupBy("conv_id", "turn").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    next_norm = norm.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("norm").alias("next_norm"))
    return dot.join(norm, ["conv_id", "turn"]).join(next_norm, ["conv_id", "turn"]).select("conv_id", "turn", F.round(F.col("dot") / (F.col("norm") * F.col("next_norm")), 4).alias("cosine"))


@queries("K12 K14", _PAIRS + """, f AS (SELECT conv_id, turn, CASE WHEN least(na, nb) > 0 THEN s / least(na, nb) ELSE 0 END AS lexical, CASE WHEN greatest(na, nb) > 0 THEN s / greatest(na, nb) ELSE 1 END AS material, s > 0 AS anchored FROM q)
SELECT conv_id, turn, round(0.55 * lexical + 0.45 * material, 4) AS support, anchored FROM f""")
def evidence_support(t: Tables) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    support = 0.55 * overlap(a, b) + 0.45 * overlap_of_larger(a, b)
    return _next_turn(t).select("conv_id", "turn", F.round(support, 4).alias("support"), F.arrays_overlap("a", "b").alias("anchored"))


@queries("K13", """WITH tok AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}'))) AS w FROM conversations), df AS (SELECT w, count(*) AS df FROM tok GROUP BY w), n AS (SELECT count(*) AS n FROM conversations),
rare AS (SELECT w, 1.0 / df AS weight FROM df, n WHERE df BETWEEN 2 AND greatest(3, ceil(0.04 * n))), hit AS (SELECT a.conv_id, a.turn, b.turn AS other, sum(weight) AS score FROM tok a JOIN tok b ON a.conv_id = b.conv_id AND a.w = b.w AND a.turn <> b.turn JOIN rare ON rare.w = a.w GROUP BY 1, 2, 3)
SELECT conv_id, turn, other, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(score, 8) DESC, other) AS rn FROM hit) WHERE rn <= 2""")
def rare_token_resolution(t: Tables) -> DataFrame:
    tok = t.conversations.select("conv_id", "turn", F.explode(F.array_distinct(words(F.col("text"), 4))).alias("w"))
    total = t.conversations.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    df = tok.groupBy("w").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df").between(2, max(3, -(-4 * total // 100))))
    rare = tok.join(df, "w").select("conv_id", "turn", "w", (1.0 / F.col("df")).alias("weight"))
    other = rare.select("conv_id", F.col("turn").alias("other"), "w")
    hit = rare.join(other, ["conv_id", "w"]).filter("turn <> other").groupBy("conv_id", "turn", "other").agg(F.sum("weight").alias("score"))
    two = ranked(hit, ["conv_id", "turn"], [F.desc(F.round("score", 8)), F.col("other")]).filter("place <= 2")
    return two.select("conv_id", "turn", "other", F.round("score", 4).alias("score"))


@queries("D18", """WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS t FROM conversations), e AS (SELECT conv_id, turn, len(t) AS n, unnest(t) AS tok FROM w),
p AS (SELECT a.conv_id, a.turn AS a, b.turn AS b, count(*) / (a.n + b.n - count(*)) AS score FROM e a JOIN e b ON a.conv_id = b.conv_id AND a.tok = b.tok AND a.turn < b.turn GROUP BY a.conv_id, a.turn, b.turn, a.n, b.n)
SELECT conv_id, a, b, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, a ORDER BY score DESC, b) AS rn FROM p) WHERE rn = 1""")
def jaccard_best_match(t: Tables) -> DataFrame:
    tokens = t.conversations.select("conv_id", "turn", F.array_distinct(words(F.col("text"), 4)).alias("tokens"))
    p = pairs_sharing(tokens, ["conv_id"], "turn", "tokens").withColumn("score", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")))
    return ranked(p, ["conv_id", "a"], [F.desc("score"), F.col("b")]).filter("place = 1").select("conv_id", "a", "b", F.round("score", 4).alias("score"))
