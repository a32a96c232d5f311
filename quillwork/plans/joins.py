"""Joins: lookups, diffs, matches, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.text import label, words
from quillwork.operators.latest import latest_per
from quillwork.operators.matching import greedy_pairs, pairs_sharing
from quillwork.plans.book import Book
from quillwork.sources.tables import Tables

queries = Book()


@queries("D1 D2 D3 F1 I4 G2", """SELECT c_custkey, coalesce(nullif(trim(c_name), ''), 'Customer ' || c_custkey) AS title, n_name AS nation, o.o_orderkey AS latest_order,
o.o_orderstatus AS latest_status, CAST(o.o_orderdate AS DATE) AS latest_date
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1) o ON o.o_custkey = c_custkey""")
def report_list(t: Tables) -> DataFrame:
    last = latest_per(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus", "o_orderdate"])
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(last, F.col("o_custkey") == F.col("c_custkey"), "left")
    title = label(F.col("c_name"), F.concat(F.lit("Customer "), F.col("c_custkey")))
    return c.select("c_custkey", title.alias("title"), F.col("n_name").alias("nation"), F.col("o_orderkey").alias("latest_order"), F.col("o_orderstatus").alias("latest_status"), F.to_date("o_orderdate").alias("latest_date")).orderBy(
        F.col("latest_date").desc_nulls_last(), "c_custkey"
    )


@queries("D4 D5", """SELECT s_suppkey, s_name, x.l_orderkey, x.l_linenumber FROM supplier LEFT JOIN (
 SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' AND c_acctbal > 0) WHERE rn = 1) x ON x.l_suppkey = s_suppkey""")
def latest_line_per_supplier(t: Tables) -> DataFrame:
    good = t.customer.filter("c_acctbal > 0").select("c_custkey")
    lines = t.lineitem.join(t.orders.filter("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey")).join(good, F.col("o_custkey") == F.col("c_custkey"))
    last = latest_per(lines, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"])
    return t.supplier.join(last, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("s_suppkey", "s_name", "l_orderkey", "l_linenumber")


@queries("D6", """SELECT a.l_orderkey, a.l_linenumber, b.l_returnflag AS approved_flag FROM lineitem a
JOIN (SELECT l_orderkey, max(l_linenumber) AS approved FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) p ON a.l_orderkey = p.l_orderkey
JOIN lineitem b ON b.l_orderkey = p.l_orderkey AND b.l_linenumber = p.approved""")
def approved_version_join(t: Tables) -> DataFrame:
    approved = t.lineitem.filter("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("l_linenumber"))
    version = approved.join(t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("approved_flag")), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "approved_flag")
    return t.lineitem.select("l_orderkey", "l_linenumber").join(version, "l_orderkey")


@queries("D8", """SELECT p_partkey, lower(p_name) AS name_key FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_returnflag = 'R' AND l.l_quantity >= 40)""")
def unreturned_parts(t: Tables) -> DataFrame:
    """Parts that never came back in a lot of forty or more."""
    returned = t.lineitem.filter("l_returnflag = 'R' and l_quantity >= 40").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.join(returned, "p_partkey", "left_anti").select("p_partkey", F.lower("p_name").alias("name_key"))


@queries("D10", """SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders,
(SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n_done, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS n_pending FROM customer""")
def project_counts(t: Tables) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("o_orderstatus") == s, True))
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), n("F").alias("n_done"), n("P").alias("n_pending"))
    return t.customer.select("c_custkey").join(counts, "c_custkey", "left").fillna(0)


@queries("D11", "SELECT c_custkey, count(o_orderkey) AS n_chunks FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def items_with_chunk_counts(t: Tables) -> DataFrame:
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n_chunks"))
    return t.customer.select("c_custkey").join(counts, "c_custkey", "left").fillna(0, "n_chunks")


def _diff(before: DataFrame, after: DataFrame, on: list[str], value: str) -> DataFrame:
    """Full outer comparison of one value by key: added, removed, changed or same."""
    joined = before.withColumnRenamed(value, "old").withColumn("was", F.lit(True)).join(after.withColumnRenamed(value, "new").withColumn("is", F.lit(True)), on, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return joined.select(*on, "old", "new", change.alias("change"))


@queries("D12 D13 E18", """WITH a AS (SELECT user_id, max(event_type) AS v FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), b AS (SELECT user_id, max(event_type) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, a.v AS old, b.v AS new, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'changed' END AS change
FROM a FULL OUTER JOIN b ON a.user_id = b.user_id""")
def change_report(t: Tables) -> DataFrame:
    kind = lambda where: t.events.filter(where).groupBy("user_id").agg(F.max("event_type").alias("v"))
    return _diff(kind("ts < timestamp_ntz '2024-01-10 00:00:00'"), kind("ts >= timestamp_ntz '2024-01-20 00:00:00'"), ["user_id"], "v")


@queries("D14", """WITH p AS (SELECT p_brand || p_type || p_size AS k, min(p_partkey) AS id, count(*) AS n FROM part GROUP BY 1), s AS (SELECT p_brand || p_type || p_size AS k, p_partkey FROM part WHERE p_size > 10)
SELECT s.p_partkey, p.id AS matched FROM s JOIN p ON s.k = p.k AND p.n = 1""")
def unambiguous_matches(t: Tables) -> DataFrame:
    k = F.concat("p_brand", "p_type", "p_size").alias("k")
    # A key that several rows carry matches nothing.
    unique = t.part.groupBy(k).agg(F.min("p_partkey").alias("matched"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    return t.part.filter("p_size > 10").select(k, "p_partkey").join(unique, "k").select("p_partkey", "matched")


@queries("D15", """WITH m AS (SELECT s_suppkey, lower(s_name) AS k FROM supplier WHERE s_suppkey % 2 = 0), c AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END AS given, lower(s_name) AS k FROM supplier)
SELECT c.id, coalesce(a.s_suppkey, b.s_suppkey) AS resolved, CASE WHEN a.s_suppkey IS NOT NULL THEN 'id' WHEN b.s_suppkey IS NOT NULL THEN 'name' END AS matched_by FROM c LEFT JOIN m a ON a.s_suppkey = c.given LEFT JOIN m b ON b.k = c.k""")
def two_tier_resolution(t: Tables) -> DataFrame:
    known = t.supplier.filter("s_suppkey % 2 = 0").select("s_suppkey", F.lower("s_name").alias("k"))
    asked = t.supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey")).alias("given"), F.lower("s_name").alias("k"))
    by_id = known.select(F.col("s_suppkey").alias("given"), F.col("s_suppkey").alias("by_id"))
    by_name = known.select("k", F.col("s_suppkey").alias("by_name"))
    found = asked.join(by_id, "given", "left").join(by_name, "k", "left")
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_name").isNotNull(), "name")
    return found.select("id", F.coalesce("by_id", "by_name").alias("resolved"), how.alias("matched_by"))


def _turn_tokens(c: DataFrame) -> DataFrame:
    return c.select("conv_id", "turn", "role", F.array_distinct(words(F.col("text"), 4)).alias("tokens"))


@queries("D16 K3 K1", """WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS t FROM conversations),
e AS (SELECT conv_id, turn, len(t) AS n, unnest(t) AS tok FROM w)
SELECT a.conv_id, a.turn AS turn_a, b.turn AS turn_b, round(count(*) / least(a.n, b.n), 4) AS score FROM e a JOIN e b ON a.conv_id = b.conv_id AND a.tok = b.tok AND a.turn < b.turn
GROUP BY a.conv_id, a.turn, b.turn, a.n, b.n HAVING count(*) / least(a.n, b.n) >= 0.3""")
def similar_turns(t: Tables) -> DataFrame:
    pairs = pairs_sharing(_turn_tokens(t.conversations), ["conv_id"], "turn", "tokens")
    score = F.col("shared") / F.least("n_a", "n_b")
    return pairs.filter(score >= 0.3).select("conv_id", F.col("a").alias("turn_a"), F.col("b").alias("turn_b"), F.round(score, 4).alias("score"))


@queries("D17 D18")
def one_to_one_turn_matches(t: Tables) -> DataFrame:
    """Questions and answers of a conversation, matched greedily by token similarity, each used once."""
    tokens = _turn_tokens(t.conversations)
    pairs = pairs_sharing(tokens, ["conv_id"], "turn", "tokens")
    score = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    return greedy_pairs(pairs.select("conv_id", "a", "b", score.alias("score")).filter("score >= 0.05"), "conv_id")


@queries("D19", """WITH e AS (SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem)
SELECT DISTINCT a.l_suppkey AS sa, b.l_suppkey AS sb, a.l_partkey AS topic FROM e a JOIN e b ON a.l_partkey = b.l_partkey AND a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey""")
def shared_evidence_pairs(t: Tables) -> DataFrame:
    e = t.lineitem.select(F.col("l_partkey").alias("topic"), "l_orderkey", "l_suppkey").distinct()
    a, b = e.withColumnRenamed("l_suppkey", "sa"), e.withColumnRenamed("l_suppkey", "sb")
    return a.join(b, ["topic", "l_orderkey"]).filter("sa < sb").select("sa", "sb", "topic").distinct()


@queries("D20 F10", """SELECT conv_id, turn, lag(text) OVER w AS previous_text, lead(text) OVER w AS next_text, right(concat_ws(' ', lag(role || ': ' || text, 2) OVER w, lag(role || ': ' || text, 1) OVER w, role || ': ' || text, lead(role || ': ' || text, 1) OVER w), 900) AS context
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def turn_neighbours(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    said = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    context = F.concat_ws(" ", F.lag(said, 2).over(w), F.lag(said, 1).over(w), said, F.lead(said, 1).over(w))
    return t.conversations.select("conv_id", "turn", F.lag("text").over(w).alias("previous_text"), F.lead("text").over(w).alias("next_text"), F.right(context, F.lit(900)).alias("context"))


def around(cited: DataFrame, rows: DataFrame, group: str, place: str, before: int, after: int) -> DataFrame:
    """Rows within a radius of cited places: offsets are exploded for an equi-join."""
    near = cited.select(group, F.explode(F.sequence(F.col(place) - before, F.col(place) + after)).alias(place)).distinct()
    return rows.join(near, [group, place], "left_semi")


@queries("D21", """SELECT DISTINCT c.conv_id, c.turn, c.role FROM conversations c JOIN conversations q ON c.conv_id = q.conv_id AND c.turn BETWEEN q.turn - 1 AND q.turn + 2 WHERE contains(q.text, '?')""")
def turns_around_questions(t: Tables) -> DataFrame:
    c = t.conversations
    return around(c.filter(F.contains("text", F.lit("?"))), c, "conv_id", "turn", 1, 2).select("conv_id", "turn", "role")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row of a key wins; rows of ``changes`` beat those of ``target``. A table format is not needed."""
    both = target.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest_per(both, keys, ["_new", *order], [c for c in target.columns if c not in keys]).select(*target.columns)


@queries("B2 B6", """WITH c AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey + 100000000, 'N', 1.0 FROM orders WHERE o_orderkey % 50 = 0)
SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM c UNION ALL SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.o_orderkey = o.o_orderkey)""")
def upserted_orders(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = o.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    added = o.filter("o_orderkey % 50 = 0").select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"))
    return upsert(o, changed.union(added), ["o_orderkey"], []).withColumn("o_totalprice", F.round("o_totalprice", 2))


@queries("B3", """WITH c AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id % 7 END AS k, value FROM events WHERE event_type = 'error')
SELECT event_id, k, value FROM c WHERE k IS NULL UNION ALL SELECT event_id, k, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY event_id DESC) AS rn FROM c WHERE k IS NOT NULL) WHERE rn = 1""")
def partial_unique_upsert(t: Tables) -> DataFrame:
    c = t.events.filter("event_type = 'error'").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id") % 7).alias("k"), "value")
    return c.filter("k is null").unionByName(latest_per(c.filter("k is not null"), ["k"], ["event_id"], ["event_id", "value"]))


@queries("B1 B4 B5 H1", """SELECT s_suppkey AS id, CAST(false AS BOOLEAN) AS created FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, true FROM supplier WHERE s_suppkey % 2 = 1""")
def insert_if_absent(t: Tables) -> DataFrame:
    existing = t.supplier.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"))
    wanted = t.supplier.select(F.col("s_suppkey").alias("id"))
    added = wanted.join(existing, "id", "left_anti")
    return existing.withColumn("created", F.lit(False)).union(added.withColumn("created", F.lit(True)))


@queries("B7 B9 B11", """SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'archived' ELSE o_orderstatus END AS status
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)""")
def deleted_and_archived(t: Tables) -> DataFrame:
    gone = t.lineitem.filter("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    debt = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("debt"))
    o = t.orders.join(gone, "o_orderkey", "left_anti").join(debt, "o_custkey", "left")
    return o.select("o_orderkey", F.when(F.col("debt"), "archived").otherwise(F.col("o_orderstatus")).alias("status"))


@queries("B8", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 2 ELSE 1 END AS revision, CASE WHEN o_orderkey % 4 = 0 THEN 'conflict' WHEN o_orderkey % 4 = 1 THEN 'updated' ELSE 'untouched' END AS outcome FROM orders""")
def compare_and_set(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.lit(1).alias("revision"))
    # Updates that expect revision 1 apply; those that expect another conflict.
    updates = t.orders.filter("o_orderkey % 4 < 2").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 1, 1).otherwise(7).alias("expected"))
    fits = F.col("expected") == F.col("revision")
    outcome = F.when(F.col("expected").isNull(), "untouched").when(fits, "updated").otherwise("conflict")
    return rows.join(updates, "o_orderkey", "left").select("o_orderkey", F.when(fits, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"), outcome.alias("outcome"))


@queries("B10", """SELECT item, chunk, status FROM (
 SELECT turn + conv_id * 1000 AS item, unnest(range(len(regexp_extract_all(text, '[^.]+')))) AS chunk, 'new' AS status FROM conversations WHERE conv_id % 2 = 0 AND len(regexp_extract_all(text, '[^.]+')) > 0
 UNION ALL SELECT turn + conv_id * 1000, NULL, 'skipped_empty' FROM conversations WHERE conv_id % 2 = 0 AND len(regexp_extract_all(text, '[^.]+')) = 0
 UNION ALL SELECT turn + conv_id * 1000, 0, 'old' FROM conversations WHERE conv_id % 2 = 1)""")
def replaced_children(t: Tables) -> DataFrame:
    """Chunks of changed items are replaced as a whole; an item without any keeps one marker row."""
    c = t.conversations.select((F.col("turn") + F.col("conv_id") * 1000).alias("item"), "conv_id", "text")
    old = c.select("item", F.lit(0).cast("long").alias("chunk"), F.lit("old").alias("status"))
    changed = c.filter("conv_id % 2 = 0").select("item", F.regexp_extract_all("text", F.lit("[^.]+"), F.lit(0)).alias("chunks"))
    new = changed.select("item", F.posexplode_outer("chunks").alias("chunk", "said"))
    new = new.select("item", F.col("chunk").cast("long").alias("chunk"), F.when(F.col("chunk").isNull(), "skipped_empty").otherwise("new").alias("status"))
    return old.join(changed.select("item"), "item", "left_anti").unionByName(new)
