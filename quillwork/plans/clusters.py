"""Deduplication, clustering and consolidation of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions.text import words
from quillwork.operators import folding
from quillwork.operators.components import connected
from quillwork.operators.matching import pairs_sharing
from quillwork.operators.summaries import merged_clusters
from quillwork.plans.book import Book
from quillwork.sources.tables import Tables

queries = Book()


def _items(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", "role", "text", F.array_distinct(words(F.col("text"), 4)).alias("tokens"))


def _similar(t: Tables, least: float) -> DataFrame:
    pairs = pairs_sharing(_items(t), ["conv_id"], "turn", "tokens")
    return pairs.filter(F.col("shared") / F.least("n_a", "n_b") >= least).select("conv_id", "a", "b")


@queries("M1 M2")
def seed_clusters(t: Tables) -> DataFrame:
    """Each turn joins the first group whose first member it resembles."""
    return folding.seed_groups(_items(t).select("conv_id", "turn", "role", "tokens"), 0.3)


@queries("M3", """WITH RECURSIVE w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS t FROM conversations), e AS (SELECT conv_id, turn, len(t) AS n, unnest(t) AS tok FROM w),
p AS (SELECT a.conv_id, a.turn AS a, b.turn AS b FROM e a JOIN e b ON a.conv_id = b.conv_id AND a.tok = b.tok AND a.turn <> b.turn GROUP BY a.conv_id, a.turn, b.turn, a.n, b.n HAVING count(*) / least(a.n, b.n) >= 0.3),
r AS (SELECT conv_id, turn, turn AS root FROM conversations UNION SELECT p.conv_id, p.b, r.root FROM r JOIN p ON p.conv_id = r.conv_id AND p.a = r.turn)
SELECT conv_id, turn, min(root) AS grp FROM r GROUP BY conv_id, turn""")
def transitive_groups(t: Tables) -> DataFrame:
    node = lambda c: F.struct("conv_id", F.col(c).alias("turn"))
    links = _similar(t, 0.3).select(node("a").alias("a"), node("b").alias("b"))
    roots = connected(links).select(F.col("node.conv_id").alias("conv_id"), F.col("node.turn").alias("turn"), F.col("root.turn").alias("grp"))
    return t.conversations.select("conv_id", "turn").join(roots, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("grp", "turn").alias("grp"))


@queries("M4")
def online_clusters(t: Tables) -> DataFrame:
    """Vectors of a label in order of id: each joins the nearest running centre or opens its own."""
    return folding.online_centroids(t.embeddings.select("label", "vec_id", "embedding"), 0.5, 0.035)


@queries("M5 M6", """SELECT p_brand || '/' || p_type AS k, count(DISTINCT p_size) AS support, max(p_retailprice) AS best, min(p_partkey) AS first_id, string_agg(DISTINCT p_size, ',' ORDER BY p_size) AS evidence FROM part GROUP BY 1""")
def merged_samples(t: Tables) -> DataFrame:
    p = t.part.select(F.concat("p_brand", F.lit("/"), "p_type").alias("k"), "p_size", "p_retailprice", "p_partkey")
    # The sizes of a key are a small domain: their set is bounded.
    sizes = F.array_join(F.sort_array(F.collect_set("p_size")).cast("array<string>"), ",")
    return p.groupBy("k").agg(F.countDistinct("p_size").alias("support"), F.max("p_retailprice").alias("best"), F.min("p_partkey").alias("first_id"), sizes.alias("evidence"))


@queries("M7", """WITH e AS (SELECT user_id, event_type, ts, event_id, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) <= 86400 THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS fam FROM e) SELECT user_id, event_type, CAST(fam AS BIGINT) AS family, count(*) AS n FROM g GROUP BY 1, 2, 3""")
def locality_families(t: Tables) -> DataFrame:
    return folding.gap_families(t.events.select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"], 86400)


@queries("M8 M10 M12")
def merged_commitments(t: Tables) -> DataFrame:
    """Turns merged into earlier ones at a threshold that rises with their distance; the fuller stays."""
    return folding.merge_by_distance(_items(t).select("conv_id", "turn", "tokens"), near=0.3, far=0.6, reach=2)


@queries("M9 M13 M15", """WITH w AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS t FROM conversations), e AS (SELECT conv_id, turn, role, len(t) AS n, unnest(t) AS tok FROM w)
SELECT a.conv_id, a.turn AS a, b.turn AS b, CASE WHEN a.role <> b.role THEN 'vetoed' WHEN count(*) = least(a.n, b.n) THEN 'contained' WHEN count(*) / least(a.n, b.n) >= 0.6 THEN 'restated' WHEN count(*) / least(a.n, b.n) >= 0.3 AND b.turn - a.turn <= 2 THEN 'near' ELSE 'distinct' END AS verdict
FROM e a JOIN e b ON a.conv_id = b.conv_id AND a.tok = b.tok AND a.turn < b.turn GROUP BY a.conv_id, a.turn, b.turn, a.role, b.role, a.n, b.n""")
def restatement_verdicts(t: Tables) -> DataFrame:
    items = _items(t)
    pairs = pairs_sharing(items, ["conv_id"], "turn", "tokens")
    role = lambda c: items.select("conv_id", F.col("turn").alias(c), F.col("role").alias(f"role_{c}"))
    p = pairs.join(role("a"), ["conv_id", "a"]).join(role("b"), ["conv_id", "b"])
    score = F.col("shared") / F.least("n_a", "n_b")
    verdict = F.when(F.col("role_a") != F.col("role_b"), "vetoed").when(F.col("shared") == F.least("n_a", "n_b"), "contained").when(score >= 0.6, "restated")
    verdict = verdict.when((score >= 0.3) & (F.col("b") - F.col("a") <= 2), "near").otherwise("distinct")
    return p.select("conv_id", "a", "b", verdict.alias("verdict"))


@queries("M11 V15", """WITH w AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS t FROM conversations), e AS (SELECT conv_id, turn, role, unnest(t) AS tok FROM w),
s AS (SELECT a.conv_id, a.turn, b.turn AS parent, count(*) AS n FROM e a JOIN e b ON a.conv_id = b.conv_id AND a.tok = b.tok WHERE a.role <> 'user' AND b.role = 'user' GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, abs(turn - parent), parent) AS rn FROM s) SELECT conv_id, turn, parent FROM r WHERE rn = 1""")
def nearest_parents(t: Tables) -> DataFrame:
    e = _items(t).select("conv_id", "turn", "role", F.explode("tokens").alias("tok"))
    core = e.filter("role = 'user'").select("conv_id", F.col("turn").alias("parent"), "tok")
    n = e.filter("role <> 'user'").join(core, ["conv_id", "tok"]).groupBy("conv_id", "turn", "parent").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("parent", F.struct("n", (-F.abs(F.col("turn") - F.col("parent"))).alias("near"), (-F.col("parent")).alias("low")))
    return n.groupBy("conv_id", "turn").agg(best.alias("parent"))


@queries("M16", """SELECT source, lang, sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def sha_duplicates(t: Tables) -> DataFrame:
    return t.documents.groupBy("source", "lang", F.sha2("text", 256).alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@queries("M17 V7", """SELECT user_id, arg_max(event_type, (CASE WHEN value > 50 THEN 1 ELSE 0 END) * 1e12 + event_id) AS winner, greatest(0.25, round(0.95 - 0.07 * (count(DISTINCT event_type) - 1), 2)) AS confidence FROM events GROUP BY user_id""")
def superseding_decisions(t: Tables) -> DataFrame:
    """The last strong statement wins, else the last; each conflict lowers the confidence."""
    strong = (F.col("value") > 50).cast("int")
    confidence = F.greatest(F.lit(0.25), F.round(0.95 - 0.07 * (F.countDistinct("event_type") - 1), 2))
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct(strong.alias("strong"), "event_id")).alias("winner"), confidence.alias("confidence"))


@queries("M4")
def mergeable_clusters(t: Tables) -> DataFrame:
    """Clusters of each label's vectors from summaries of ranges of ids, merged in a tree; a label is many tasks'."""
    v = t.embeddings.select(F.col("label").cast("string").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return merged_clusters(v, 0.5).select(F.col("grp").cast("int").alias("label"), F.col("id").alias("vec_id"), "cluster")
