"""Restatements, owners, people and evidence: which records are one, and what supports them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.fuzzy import partial_ratio
from quillwork.functions.text import bounded, overlap, words
from quillwork.operators.candidates import best_sharing
from quillwork.operators.components import connected, written
from quillwork.operators.latest import ranked
from quillwork.operators.matching import SALTS, greedy_by_wording, pairs_sharing
from quillwork.operators.retrieval import rows_above
from quillwork.plans.book import Book
from quillwork.plans.discourse import cued_turns
from quillwork.sources.tables import Tables

queries = Book()

_OWNER = "CASE role WHEN 'user' THEN 'Ann' WHEN 'assistant' THEN 'Ben' END"


def _items(t: Tables) -> DataFrame:
    owner = F.when(F.col("role") == "user", "Ann").when(F.col("role") == "assistant", "Ben")
    return t.conversations.select("conv_id", "turn", owner.alias("owner"), "text", F.array_distinct(words(F.col("text"), 4)).alias("tokens"))


TOKENS = f"w AS (SELECT conv_id, turn, {_OWNER} AS owner, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{4,}}')) AS t FROM conversations), e AS (SELECT conv_id, turn, owner, len(t) AS n, unnest(t) AS tok FROM w)"


@queries("M12", f"""WITH {TOKENS}, f AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{4,}}')) AS tok FROM w), tf AS (SELECT conv_id, turn, tok, count(*) AS c FROM f GROUP BY 1, 2, 3), nm AS (SELECT conv_id, turn, sqrt(sum(c * c)) AS norm FROM tf GROUP BY 1, 2),
d AS (SELECT a.conv_id, a.turn, sum(a.c * b.c) AS dot, count(*) AS shared FROM tf a JOIN tf b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.tok = b.tok GROUP BY 1, 2), s AS (SELECT d.conv_id, d.turn, dot / (x.norm * y.norm) AS cosine, shared / least(len(p.t), len(q.t)) AS lexical FROM d JOIN nm x ON x.conv_id = d.conv_id AND x.turn = d.turn JOIN nm y ON y.conv_id = d.conv_id AND y.turn = d.turn + 1 JOIN w p ON p.conv_id = d.conv_id AND p.turn = d.turn JOIN w q ON q.conv_id = d.conv_id AND q.turn = d.turn + 1)
SELECT conv_id, turn, round(cosine, 4) AS cosine, round(lexical, 4) AS lexical, (round(cosine, 4) >= 0.70 AND round(lexical, 4) >= 0.35) OR round(lexical, 4) >= 0.82 AS restated FROM s""")
def adjacent_restatements(t: Tables) -> DataFrame:
    """A turn and the next one: cosine of word counts, overlap of words, and whether they say the same."""
    rows = t.conversations.select("conv_id", "turn", words(F.col("text"), 4).alias("all"))
    counts = rows.select("conv_id", "turn", F.explode("all").alias("tok")).groupBy("conv_id", "turn", "tok").agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy("conv_id", "turn").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"), F.count(F.lit(1)).alias("n"))
    after = counts.select("conv_id", (F.col("turn") - 1).alias("turn"), "tok", F.col("c").alias("d"))
    both = counts.join(after, ["conv_id", "turn", "tok"]).groupBy("conv_id", "turn").agg(F.sum(F.col("c") * F.col("d")).alias("dot"), F.count(F.lit(1)).alias("shared"))
    later = sizes.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("norm").alias("norm_b"), F.col("n").alias("n_b"))
    s = both.join(sizes, ["conv_id", "turn"]).join(later, ["conv_id", "turn"])
    s = s.select("conv_id", "turn", F.round(F.col("dot") / (F.col("norm") * F.col("norm_b")), 4).alias("cosine"), F.round(F.col("shared") / F.least("n", "n_b"), 4).alias("lexical"))
    return s.withColumn("restated", ((F.col("cosine") >= 0.70) & (F.col("lexical") >= 0.35)) | (F.col("lexical") >= 0.82))


def like_turns(t: Tables, least: float) -> DataFrame:
    """conv_id, a, b (a < b) and score of turns whose words overlap so far, with both owners."""
    items = _items(t)
    pairs = pairs_sharing(items, ["conv_id"], "turn", "tokens").withColumn("score", F.round(F.col("shared") / F.least("n_a", "n_b"), 6)).filter(F.col("score") >= least)
    own = lambda side: items.select("conv_id", F.col("turn").alias(side), F.col("owner").alias(f"owner_{side}"))
    return pairs.join(own("a"), ["conv_id", "a"]).join(own("b"), ["conv_id", "b"]).select("conv_id", "a", "b", "score", "owner_a", "owner_b")


def groups_of(t: Tables, links: DataFrame) -> DataFrame:
    """conv_id, turn, owner and grp: the least turn that links lead to."""
    node = lambda c: F.struct("conv_id", F.col(c).alias("turn"))
    roots = connected(links.select(node("a").alias("a"), node("b").alias("b"))).select("node.conv_id", "node.turn", F.col("root.turn").alias("grp"))
    return _items(t).select("conv_id", "turn", "owner").join(roots, ["conv_id", "turn"], "left").withColumn("grp", F.coalesce("grp", "turn"))


LIKE_TURNS = """p AS (SELECT conv_id, a, b, score, owner_a, owner_b FROM (SELECT a.conv_id, a.turn AS a, b.turn AS b, a.owner AS owner_a, b.owner AS owner_b, round(count(*) / least(a.n, b.n), 6) AS score FROM e a JOIN e b ON a.conv_id = b.conv_id AND a.tok = b.tok AND a.turn < b.turn GROUP BY a.conv_id, a.turn, b.turn, a.owner, b.owner, a.n, b.n) WHERE score >= {least}{more}),
g AS (SELECT conv_id, a AS x, b AS y FROM p UNION ALL SELECT conv_id, b, a FROM p), r AS (SELECT conv_id, turn, turn AS root FROM conversations UNION SELECT g.conv_id, g.y, r.root FROM r JOIN g ON g.conv_id = r.conv_id AND g.x = r.turn), k AS (SELECT w.conv_id, w.turn, w.owner, min(root) AS grp FROM r JOIN w ON w.conv_id = r.conv_id AND w.turn = r.turn GROUP BY 1, 2, 3)"""


@queries("M2", f"""WITH RECURSIVE {TOKENS}, {LIKE_TURNS.format(least=0.3, more='')}, o AS (SELECT conv_id, grp, count(DISTINCT owner) AS owners, max(owner) AS any_owner FROM k GROUP BY 1, 2),
l AS (SELECT conv_id, a AS turn, b AS other, score, owner_b AS partner FROM p UNION ALL SELECT conv_id, b, a, score, owner_a FROM p), best AS (SELECT conv_id, turn, partner FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, other) AS rn FROM l WHERE partner IS NOT NULL) WHERE rn = 1)
SELECT k.conv_id, k.turn, k.grp, coalesce(k.owner, CASE WHEN owners = 1 THEN any_owner WHEN owners > 1 THEN partner END) AS cluster_owner FROM k JOIN o USING (conv_id, grp) LEFT JOIN best ON best.conv_id = k.conv_id AND best.turn = k.turn""")
def owner_split_groups(t: Tables) -> DataFrame:
    """Groups of like turns, split by named owners; a turn of no owner goes with the only owner, else
    with the owner of its best link, and stays alone without one."""
    links = like_turns(t, 0.3)
    k = groups_of(t, links)
    owners = k.groupBy("conv_id", "grp").agg(F.countDistinct("owner").alias("owners"), F.max("owner").alias("any_owner"))
    either = links.select("conv_id", F.col("a").alias("turn"), F.col("b").alias("other"), "score", F.col("owner_b").alias("partner")).union(links.select("conv_id", "b", "a", "score", "owner_a"))
    best = either.filter("partner is not null").groupBy("conv_id", "turn").agg(F.max_by("partner", F.struct("score", -F.col("other"))).alias("partner"))
    joined = k.join(owners, ["conv_id", "grp"]).join(best, ["conv_id", "turn"], "left")
    given = F.when(F.col("owners") == 1, F.col("any_owner")).when(F.col("owners") > 1, F.col("partner"))
    return joined.select("conv_id", "turn", "grp", F.coalesce("owner", given).alias("cluster_owner"))


@queries("M5", f"""WITH RECURSIVE {TOKENS}, {LIKE_TURNS.format(least=0.4, more=" AND (owner_a IS NULL OR owner_b IS NULL OR owner_a = owner_b)")} SELECT conv_id, grp, count(*) AS members, count(DISTINCT turn % 3) AS support, string_agg(turn, ',' ORDER BY turn) AS evidence FROM k GROUP BY 1, 2""")
def samples_of_one_meaning(t: Tables) -> DataFrame:
    """Rows of several samples merged where their words overlap and their owners don't differ; support is the number of samples."""
    links = like_turns(t, 0.4).filter("owner_a is null or owner_b is null or owner_a = owner_b")
    evidence = F.array_join(F.sort_array(F.collect_list("turn")).cast("array<string>"), ",")
    return groups_of(t, links).groupBy("conv_id", "grp").agg(F.count(F.lit(1)).alias("members"), F.countDistinct(F.col("turn") % 3).alias("support"), evidence.alias("evidence"))


@queries("M6", """SELECT l_partkey, l_suppkey, count(*) AS rows, min(l_orderkey * 10 + l_linenumber) AS first_row, arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) FILTER (WHERE l_returnflag <> 'N') AS owner, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS evidence FROM lineitem GROUP BY 1, 2""")
def pooled_duplicates(t: Tables) -> DataFrame:
    """Rows of one key as one: the first one's id, the first owner that any of them names, all kinds of evidence."""
    row = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    named = F.min(F.when(F.col("l_returnflag") != "N", F.struct(row.alias("row"), "l_returnflag")))["l_returnflag"]
    evidence = F.array_join(F.sort_array(F.collect_set("l_linestatus")), ",")  # a small domain
    return t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("rows"), F.min(row).alias("first_row"), named.alias("owner"), evidence.alias("evidence"))


@queries("M7", """WITH e AS (SELECT user_id, event_id, event_type, value, CASE WHEN event_id % 3 = 0 THEN 'x' WHEN event_id % 3 = 1 THEN 'y' END AS owner, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events), l AS (SELECT *, lag(turn) OVER w AS last_turn, lag(value) OVER w AS last_value, last_value(owner IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_owner FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY turn)),
n AS (SELECT *, CASE WHEN last_turn IS NULL OR (last_owner IS NOT NULL AND owner IS NOT NULL AND owner <> last_owner) OR (turn - last_turn > 60 AND value <> last_value) THEN 1 ELSE 0 END AS new FROM l), f AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY turn) AS family FROM n)
SELECT user_id, event_type, CAST(family AS BIGINT) AS family, count(*) AS n, max(owner) AS owner FROM f GROUP BY 1, 2, 3""")
def owned_families(t: Tables) -> DataFrame:
    """Runs of one type whose owners don't differ and that are at most 60 turns apart, or of one value."""
    k = F.col("event_id") % 3
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = t.events.select("user_id", "event_id", "event_type", "value", F.when(k == 0, "x").when(k == 1, "y").alias("owner"), turn.alias("turn"))
    by = Window.partitionBy("user_id", "event_type").orderBy("turn")
    before = F.last("owner", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumns({"last_turn": F.lag("turn").over(by), "last_value": F.lag("value").over(by), "last_owner": before})
    new = F.col("last_turn").isNull() | F.coalesce(F.col("owner") != F.col("last_owner"), F.lit(False)) | ((F.col("turn") - F.col("last_turn") > 60) & (F.col("value") != F.col("last_value")))
    f = e.withColumn("family", F.sum(new.cast("long")).over(by))
    return f.groupBy("user_id", "event_type", "family").agg(F.count(F.lit(1)).alias("n"), F.max("owner").alias("owner"))


FIRST = ("Maria", "Jonas", "Aisha", "Pierre", "Lucia", "Henrik", "Olga", "Samuel", "Yuki", "Carlos", "Ingrid", "Dmitri")
LAST = ("Hoffmann", "Delacroix", "Okonkwo", "Petrov", "Lindqvist", "Moreau", "Castillo", "Nakamura", "Brennan", "Fischer", "Oliveira", "Kowalski")
_LISTS = tuple("[" + ", ".join(f"'{x}'" for x in xs) + "]" for xs in (FIRST, LAST))
_PEOPLE = f"""people AS (SELECT s_suppkey AS id, lower(first) AS first, lower(last) AS last, CASE s_suppkey % 8 WHEN 0 THEN first || ' ' || last WHEN 1 THEN first WHEN 2 THEN last WHEN 3 THEN first || ' ' || last[1] WHEN 4 THEN last || ', ' || first WHEN 5 THEN first || ' ' || last[1:3] || last[5:] WHEN 6 THEN first[1:2] || first[4:] || ' ' || last ELSE 'Nobody Known' END AS said
FROM (SELECT s_suppkey, ({_LISTS[0]})[1 + s_suppkey % 12] AS first, ({_LISTS[1]})[1 + (s_suppkey // 12) % 12] || ['', 'son', 'ez', 'ova'][1 + (s_suppkey // 144) % 4] AS last FROM supplier))"""


def _people(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    s = t.supplier.select(k.alias("id"), pick(FIRST, k % 12).alias("first"), F.concat(pick(LAST, F.floor(k / 12) % 12), pick(("", "son", "ez", "ova"), F.floor(k / 144) % 4)).alias("last"))
    first, last, k = F.col("first"), F.col("last"), F.col("id") % 8
    said = F.when(k == 0, F.concat_ws(" ", first, last)).when(k == 1, first).when(k == 2, last).when(k == 3, F.concat(first, F.lit(" "), F.substring(last, 1, 1))).when(k == 4, F.concat_ws(", ", last, first))
    said = said.when(k == 5, F.concat(first, F.lit(" "), F.substring(last, 1, 3), F.substr(last, F.lit(5)))).when(k == 6, F.concat(F.substring(first, 1, 2), F.substr(first, F.lit(4)), F.lit(" "), last)).otherwise("Nobody Known")
    return s.select("id", F.lower(first).alias("first"), F.lower(last).alias("last"), said.alias("said"))


def _shorter(c: Column) -> Column:
    """A word and all words with one letter left out: words within one edit share one."""
    left_out = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))
    return F.array_distinct(F.concat(F.array(c), left_out))


@queries("K10 K11", f"""WITH {_PEOPLE}, n AS (SELECT id AS asked, said, string_split(CASE WHEN contains(said, ', ') THEN regexp_replace(lower(said), '^(.*), (.*)$', '\\2 \\1') ELSE lower(said) END, ' ') AS w FROM people),
exact AS (SELECT asked, count(*) AS n, min(p.id) AS id FROM n JOIN people p ON w[1] = p.first AND w[2] = p.last AND len(w) = 2 GROUP BY asked), near AS (SELECT asked, count(*) AS n, min(p.id) AS id FROM n JOIN people p ON CASE WHEN len(w) = 1 THEN levenshtein(w[1], p.first) <= 1 OR (length(w[1]) >= 7 AND levenshtein(w[1], p.last) <= 1) ELSE levenshtein(w[1], p.first) <= 1 AND (levenshtein(w[2], p.last) <= 1 OR w[2] = p.last[1]) END GROUP BY asked)
SELECT n.asked, said, CASE WHEN exact.n = 1 THEN exact.id WHEN exact.n IS NULL AND near.n = 1 THEN near.id END AS resolved, CASE WHEN exact.n = 1 THEN 'exact' WHEN exact.n > 1 OR near.n > 1 THEN 'ambiguous' WHEN near.n = 1 THEN 'near' ELSE 'unknown' END AS how FROM n LEFT JOIN exact USING (asked) LEFT JOIN near USING (asked)""")
def people_resolved(t: Tables) -> DataFrame:
    """Names as said, resolved to the one person they can mean: exactly, else by first name, long surname,
    initial or one edit in either part. Candidates share a word with one letter left out, so no pair of
    names is compared that can't match. Each wording is compared once with each distinct name, however many
    people say or bear either; the bearers are counted."""
    people = _people(t)
    said = F.lower("said")
    w = F.split(F.when(F.contains(said, F.lit(", ")), F.regexp_replace(said, "^(.*), (.*)$", "$2 $1")).otherwise(said), " ")
    asked = people.select(F.col("id").alias("asked"), "said", w.alias("w"))
    names = written(people.groupBy("first", "last").agg(F.countDistinct("id").alias("bearers"), F.min("id").alias("id")))
    worded = written(asked.select("w").distinct())
    tally = lambda found, name: found.groupBy("w").agg(F.sum("bearers").alias(f"n_{name}"), F.min("id").alias(name))
    two = worded.filter(F.size("w") == 2).withColumns({"w1": F.col("w")[0], "w2": F.col("w")[1]})
    exact = tally(two.join(names, (F.col("w1") == F.col("first")) & (F.col("w2") == F.col("last"))), "exact")
    one = worded.filter(F.size("w") == 1).withColumn("w1", F.col("w")[0]).withColumn("key", F.explode(_shorter(F.col("w1"))))
    by = lambda c: names.withColumn("key", F.explode(_shorter(F.col(c))))
    met = lambda pairs: pairs.select("w", "first", "last", "bearers", "id")
    near = met(one.join(by("first"), "key").filter(F.levenshtein("w1", "first") <= 1))
    near = near.union(met(one.filter(F.length("w1") >= 7).join(by("last"), "key").filter(F.levenshtein("w1", "last") <= 1)))
    pairs = lambda df, a, b: df.withColumn("key_a", F.explode(_shorter(F.col(a)))).withColumn("key_b", F.explode(b))
    initial = F.substring("last", 1, 1)
    full = pairs(two, "w1", _shorter(F.col("w2"))).join(pairs(names, "first", _shorter(F.col("last"))), ["key_a", "key_b"]).filter((F.levenshtein("w1", "first") <= 1) & (F.levenshtein("w2", "last") <= 1))
    short = pairs(two.filter(F.length("w2") == 1), "w1", F.array("w2")).join(pairs(names, "first", F.array(initial)), ["key_a", "key_b"]).filter(F.levenshtein("w1", "first") <= 1)
    near = tally(near.union(met(full)).union(met(short)).distinct(), "near")
    answers = worded.join(exact, "w", "left").join(near, "w", "left")
    # An answer goes to all who say the wording, dealt to SALTS tasks where those are many.
    out = asked.withColumn("salt", (F.pmod(F.xxhash64("asked"), F.lit(SALTS))).cast("int")).join(written(answers).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["w", "salt"])
    resolved = F.when(F.col("n_exact") == 1, F.col("exact")).when(F.col("n_exact").isNull() & (F.col("n_near") == 1), F.col("near"))
    how = F.when(F.col("n_exact") == 1, "exact").when((F.col("n_exact") > 1) | (F.col("n_near") > 1), "ambiguous").when(F.col("n_near") == 1, "near").otherwise("unknown")
    return out.select("asked", "said", resolved.alias("resolved"), how.alias("how"))


_NEGATIVE = r"\b(?:no|not|never|nicht|kein|ne|pas|nunca)\b"
_CLAIMS = r"c AS (SELECT conv_id, turn, text AS claim, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS evidence FROM conversations), x AS (SELECT *, list_distinct(regexp_extract_all(lower(claim), '[a-z0-9]{3,}')) AS a, list_distinct(regexp_extract_all(lower(evidence), '[a-z0-9]{3,}')) AS b, list_distinct(regexp_extract_all(lower(claim), '[a-z0-9]{6,}')) AS m, list_distinct(regexp_extract_all(claim, '[0-9]+')) AS figures, list_distinct(regexp_extract_all(claim, '\b[A-Z][a-z]{2,}|\b[0-9]+')) AS p, list_distinct(regexp_extract_all(evidence, '\b[A-Z][a-z]{2,}|\b[0-9]+')) AS q FROM c WHERE evidence IS NOT NULL)"


@queries("K12 K14", rf"""WITH {_CLAIMS}, s AS (SELECT *, CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0 END AS lexical, CASE WHEN len(m) > 0 THEN len(list_intersect(m, b)) / len(m) ELSE 0 END AS material, regexp_matches(lower(claim), '{_NEGATIVE}') AS neg_a, regexp_matches(lower(evidence), '{_NEGATIVE}') AS neg_b FROM x)
SELECT conv_id, turn, CASE WHEN len(list_filter(figures, lambda f: NOT contains(evidence, f))) > 0 THEN 0.0 ELSE greatest(0.0, round(0.55 * lexical + 0.45 * material - CASE WHEN neg_a AND NOT neg_b THEN 0.35 ELSE 0 END + 1e-9, 4)) END AS support, len(list_intersect(p, q)) > 0 AS anchored FROM s""")
def claim_support(t: Tables) -> DataFrame:
    """How far the next turn supports what a turn says: words and long words in common, less for a negation
    that the evidence lacks, nothing where one of its figures is missing; and whether a name or figure is shared."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = t.conversations.select("conv_id", "turn", F.col("text").alias("claim"), after.alias("evidence")).filter("evidence is not null")
    found = lambda col, p: F.array_distinct(F.regexp_extract_all(col, F.lit(p), F.lit(0)))
    claim, evidence = F.col("claim"), F.col("evidence")
    a, b, m = words(claim, 3), F.array_distinct(words(evidence, 3)), F.array_distinct(words(claim, 6))
    material = F.when(F.size(m) > 0, F.size(F.array_intersect(m, b)) / F.size(m)).otherwise(0.0)
    penalty = F.when(F.lower(claim).rlike(bounded(_NEGATIVE)) & ~F.lower(evidence).rlike(bounded(_NEGATIVE)), 0.35).otherwise(0.0)
    missing = F.exists(found(claim, "[0-9]+"), lambda f: ~F.contains(evidence, f))
    score = F.greatest(F.lit(0.0), F.round(0.55 * overlap(F.array_distinct(a), b) + 0.45 * material - penalty + 1e-9, 4))
    anchors = bounded(r"\b[A-Z][a-z]{2,}|\b[0-9]+")
    return c.select("conv_id", "turn", F.when(missing, 0.0).otherwise(score).alias("support"), F.arrays_overlap(found(claim, anchors), found(evidence, anchors)).alias("anchored"))


@queries("K13", f"""WITH {TOKENS}, df AS (SELECT tok, count(*) AS df FROM e GROUP BY tok), z AS (SELECT count(*) AS n FROM conversations), rare AS (SELECT e.conv_id, e.turn, e.n, e.tok, 1.0 / df AS weight FROM e JOIN df USING (tok), z WHERE df BETWEEN 2 AND greatest(3, ceil(0.04 * z.n))), own AS (SELECT conv_id, turn, sum(weight) AS whole FROM rare GROUP BY 1, 2),
h AS (SELECT a.conv_id, a.turn, b.turn AS other, sum(a.weight) AS hit FROM rare a JOIN rare b ON a.conv_id = b.conv_id AND a.tok = b.tok AND a.turn <> b.turn GROUP BY 1, 2, 3), base AS (SELECT a.conv_id, a.turn, b.turn AS other, count(*) / least(a.n, b.n) AS base FROM e a JOIN e b ON a.conv_id = b.conv_id AND a.tok = b.tok AND a.turn <> b.turn GROUP BY a.conv_id, a.turn, b.turn, a.n, b.n),
s AS (SELECT conv_id, turn, other, round(0.25 * base + 0.75 * hit / whole + 1e-9, 4) AS score FROM h JOIN own USING (conv_id, turn) JOIN base USING (conv_id, turn, other)) SELECT conv_id, turn, other, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, other) AS rn FROM s) WHERE rn <= 2""")
def evidence_resolved(t: Tables) -> DataFrame:
    """The two turns that a turn most likely rests on: a quarter overlap, three quarters of the weight of its
    rare words that they hold."""
    items = _items(t)
    e = items.select("conv_id", "turn", F.explode("tokens").alias("tok"))
    most = max(3, -(-4 * t.conversations.count() // 100))
    df = e.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df").between(2, most))
    rare = e.join(df, "tok").select("conv_id", "turn", "tok", (1.0 / F.col("df")).alias("weight"))
    whole = rare.groupBy("conv_id", "turn").agg(F.sum("weight").alias("whole"))
    hit = rare.join(rare.select("conv_id", F.col("turn").alias("other"), "tok"), ["conv_id", "tok"]).filter("turn <> other").groupBy("conv_id", "turn", "other").agg(F.sum("weight").alias("hit"))
    half = pairs_sharing(items, ["conv_id"], "turn", "tokens").withColumn("base", F.col("shared") / F.least("n_a", "n_b"))
    base = half.select("conv_id", F.col("a").alias("turn"), F.col("b").alias("other"), "base").union(half.select("conv_id", "b", "a", "base"))
    s = hit.join(whole, ["conv_id", "turn"]).join(base, ["conv_id", "turn", "other"])
    s = s.select("conv_id", "turn", "other", F.round(0.25 * F.col("base") + 0.75 * F.col("hit") / F.col("whole") + 1e-9, 4).alias("score"))
    return ranked(s, ["conv_id", "turn"], [F.desc("score"), F.col("other")]).filter("place <= 2").select("conv_id", "turn", "other", "score")


@queries("L6 U6", """WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS t FROM benchmark), f AS (SELECT item_id, list_sort(t)[1:12] AS t FROM q), x AS (SELECT item_id, unnest(t) AS w FROM f), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}'))) AS w FROM documents),
s AS (SELECT item_id, doc_id, count(*) AS score FROM x JOIN d USING (w) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS rn FROM s), a AS (SELECT item_id, string_agg(doc_id || ':' || score, ',' ORDER BY rn) AS sources FROM r WHERE rn <= 3 GROUP BY 1), newest AS (SELECT string_agg(doc_id, ',' ORDER BY doc_id DESC) AS ids FROM (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 3))
SELECT q.item_id, coalesce(sources, newest.ids) AS sources, CASE WHEN sources IS NULL THEN 'fallback' ELSE 'keyword' END AS how FROM q LEFT JOIN a USING (item_id), newest""")
def answer_sources(t: Tables) -> DataFrame:
    """What an answer to each item would be given to read: the three documents with most of its words (twelve
    at most), the newest first among equals; without any, the newest three."""
    tokens = F.array_distinct(words(F.col("text"), 4))
    asked = written(t.benchmark.select(F.col("item_id").alias("item"), F.slice(F.sort_array(tokens), 1, 12).alias("words")))
    three, _ = best_sharing(asked, t.documents.select(F.col("doc_id").alias("row"), tokens.alias("words")), 3, F.desc("row"))
    one = F.struct("place", F.concat_ws(":", "row", "shared").alias("said"))
    found = three.groupBy(F.col("item").alias("item_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["said"]), ",").alias("sources"))
    top = t.documents.select("doc_id").orderBy(F.desc("doc_id")).limit(3)
    newest = top.agg(F.array_join(F.sort_array(F.collect_list("doc_id"), asc=False).cast("array<string>"), ",").alias("newest"))  # one row
    out = t.benchmark.select("item_id").join(found, "item_id", "left").join(F.broadcast(newest))
    return out.select("item_id", F.coalesce("sources", "newest").alias("sources"), F.when(F.col("sources").isNull(), "fallback").otherwise("keyword").alias("how"))


@queries("D16", """WITH q AS (SELECT vec_id AS q, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q, vec_id, list_sum(list_transform(range(1, len(v) + 1), lambda i: CAST(v[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE))) AS score FROM q, embeddings WHERE q <> vec_id) SELECT q, vec_id, round(score, 4) AS score FROM s WHERE round(score, 4) >= 0.3""")
def similar_vectors(t: Tables) -> DataFrame:
    """Every row whose cosine with a query row is 0.3 or more; the queries are the rows whose id is
    divisible by 20, against all rows, block by block."""
    found = rows_above(t.embeddings.filter("vec_id % 20 = 0"), t.embeddings, 0.3)
    return found.filter("q <> vec_id")


@queries("D18")
def jaccard_matches_used_once(t: Tables) -> DataFrame:
    """Parts of even keys matched to odd ones of their brand and size by words in common, best first, each used
    once; below 0.38 none."""
    tokens = F.array_distinct(F.concat(words(F.col("p_name")), words(F.col("p_type"))))
    wording = F.array_join(F.sort_array(tokens), " ")
    parts = t.part.select(F.concat_ws("/", "p_brand", "p_size").alias("grp"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 2 == 0).alias("context"), wording.alias("wording")).filter("context is not null")
    # Parts of one wording have one score: wordings of a group are compared, however many parts bear them.
    each = written(parts.select("grp", "context", "wording").distinct()).withColumn("tokens", F.split("wording", " "))
    side = lambda own, key: each.filter(F.col("context") == own).select("grp", F.col("wording").alias(f"wording_{key}"), F.size("tokens").alias(f"n_{key}"), F.explode("tokens").alias("tok")).filter("tok <> ''")
    p = side(True, "a").join(side(False, "b"), ["grp", "tok"]).groupBy("grp", "wording_a", "wording_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared"))
    p = p.select("grp", "wording_a", "wording_b", F.round(F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")), 6).alias("score"))
    return greedy_by_wording(parts, p.filter("score >= 0.38"), "grp")


@queries("V4")
def best_phrases(t: Tables) -> DataFrame:
    """Each part's label given to the name of its brand and size that it most resembles: 100 where that stands
    in the label, none where no word is shared, else the best window's ratio; below 85 no name."""
    label = F.lower(F.concat_ws(" ", F.substring("p_type", 1, 4), "p_name"))
    parts = t.part.select("p_partkey", F.concat_ws("/", "p_brand", "p_size").alias("grp"), label.alias("label"), F.lower("p_name").alias("name"))
    # Parts of one label have one answer: a label of a group is compared once.
    asked = parts.filter("p_partkey % 2 = 0").select("grp", "label").distinct().select("grp", "label", F.explode(F.array_distinct(words(F.col("label")))).alias("tok"))
    names = parts.filter("p_partkey % 2 = 1").select("grp", "name").distinct().withColumn("tok", F.explode(F.array_distinct(words(F.col("name")))))
    pairs = asked.join(names, ["grp", "tok"]).select("grp", "label", "name").distinct()
    scored = pairs.select("grp", "label", "name", F.when(F.contains("label", "name"), 100.0).otherwise(partial_ratio("label", "name")).alias("score")).filter("score >= 85")
    best = scored.groupBy("grp", "label").agg(F.min(F.struct((-F.col("score")).alias("low"), "name")).alias("b"))
    return parts.filter("p_partkey % 2 = 0").join(best, ["grp", "label"]).select("p_partkey", F.col("b.name").alias("name"), (-F.col("b.low")).alias("score"))


def _tallied(pdf: pd.DataFrame) -> pd.DataFrame:
    """One conversation's made turns against its expected ones, in order, each expected one used once."""
    rows = sorted(zip(pdf["turn"], pdf["role"], map(set, pdf["tokens"]), strict=True), key=lambda r: r[0])
    open_ones = {turn: s for turn, role, s in rows if role == "user"}
    made, expected = [s for _, role, s in rows if role != "user"], dict(open_ones)
    likeness = lambda a, b: len(a & b) / min(len(a), len(b)) if a and b else 0.0
    counts = {"matched": 0, "strict": 0, "repeats": 0, "noise": 0}
    for s in made:
        score, turn = max(((likeness(s, e), -k) for k, e in open_ones.items()), default=(0.0, 0))
        if score >= 0.55:
            counts["matched"] += 1
            counts["strict"] += score >= 0.70
            del open_ones[-turn]
        elif max((likeness(s, e) for e in expected.values()), default=0.0) >= 0.55:
            counts["repeats"] += 1
        else:
            counts["noise"] += 1
    share = lambda n, of: round(n / of, 4) if of else 1.0
    return pd.DataFrame([{"conv_id": int(pdf["conv_id"].iloc[0]), "recall": share(counts["matched"], len(expected)), "strict_recall": share(counts["strict"], len(expected)), "precision": share(counts["matched"], len(made)), "repeats": counts["repeats"], "noise": counts["noise"]}])


@queries("Q3")
def scored_runs(t: Tables) -> DataFrame:
    """Recall at two thresholds, precision, repeats and noise of what others said against what the user asked for."""
    turns = cued_turns(t).select("conv_id", "turn", "role", F.array_distinct(words(F.col("said"), 3)).alias("tokens"))
    return turns.groupBy("conv_id").applyInPandas(_tallied, "conv_id long, recall double, strict_recall double, precision double, repeats long, noise long")
