"""Latest rows, windows, ranking and paging, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.text import key
from quillwork.operators.latest import first_per, latest_per, ranked
from quillwork.plans.book import Book
from quillwork.sources.tables import Tables

queries = Book()


@queries("F3", """SELECT k, value, scope FROM (SELECT lower(event_type) || (user_id % 50) AS k, value, CASE WHEN user_id % 2 = 0 THEN 'exact' ELSE 'global' END AS scope, row_number() OVER (PARTITION BY lower(event_type) || (user_id % 50) ORDER BY CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 END, ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def precedence_per_key(t: Tables) -> DataFrame:
    k = F.concat(F.lower("event_type"), F.col("user_id") % 50)
    e = t.events.select(k.alias("k"), "value", F.when(F.col("user_id") % 2 == 0, "exact").otherwise("global").alias("scope"), "ts", "event_id")
    return latest_per(e.withColumn("exact", (F.col("scope") == "exact").cast("int")), ["k"], ["exact", "ts", "event_id"], ["value", "scope"])


@queries("F4 O2", """SELECT o_custkey, max(CASE WHEN rn = 1 THEN o_orderstatus END) AS now, max(CASE WHEN rn = 2 THEN o_orderstatus END) AS before,
CASE WHEN max(CASE WHEN rn = 2 THEN o_orderstatus END) IS NULL THEN 'new_update' WHEN max(CASE WHEN rn = 1 THEN o_orderstatus END) = max(CASE WHEN rn = 2 THEN o_orderstatus END) THEN 'stable'
WHEN max(CASE WHEN rn = 1 THEN o_orderstatus END) = 'F' THEN 'resolved' WHEN max(CASE WHEN rn = 1 THEN o_orderstatus END) = 'O' AND max(CASE WHEN rn = 2 THEN o_orderstatus END) = 'P' THEN 'improving' ELSE 'deteriorating' END AS trend
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 2 GROUP BY o_custkey""")
def latest_and_previous_trend(t: Tables) -> DataFrame:
    place = ranked(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).filter("place <= 2")
    at = lambda n: F.max(F.when(F.col("place") == n, F.col("o_orderstatus")))
    two = place.groupBy("o_custkey").agg(at(1).alias("now"), at(2).alias("before"))
    trend = F.when(F.col("before").isNull(), "new_update").when(F.col("now") == F.col("before"), "stable").when(F.col("now") == "F", "resolved")
    return two.withColumn("trend", trend.when((F.col("now") == "O") & (F.col("before") == "P"), "improving").otherwise("deteriorating"))


@queries("F5 H6", """SELECT k, doc_id FROM (SELECT trim(regexp_replace(lower(trim(source || ' ' || lang)), '[^a-z0-9]+', '_', 'g'), '_') AS k, doc_id, row_number() OVER (PARTITION BY trim(regexp_replace(lower(trim(source || ' ' || lang)), '[^a-z0-9]+', '_', 'g'), '_') ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1 AND k <> ''""")
def first_by_key(t: Tables) -> DataFrame:
    rows = t.documents.select(key(F.concat_ws(" ", "source", "lang")).alias("k"), "doc_id").filter("k <> ''")
    return first_per(rows, ["k"], ["doc_id"], ["doc_id"])


@queries("F6", """SELECT conv_id, turn, round(avg(length(text)) OVER w, 4) AS mean_size, max(length(text)) OVER w AS most, lead(role, 1) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)""")
def sliding_turn_windows(t: Tables) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    w = order.rowsBetween(0, 2)
    return t.conversations.select("conv_id", "turn", F.round(F.avg(F.length("text")).over(w), 4).alias("mean_size"), F.max(F.length("text").cast("long")).over(w).alias("most"), F.lead("role").over(order).alias("next_role"))


@queries("F7", """SELECT conv_id, turn, CASE WHEN role = 'user' AND r1 = 'assistant' AND r2 = 'user' THEN 'request-answer-reply' WHEN role = 'user' AND r1 = 'assistant' THEN 'request-answer' ELSE 'other' END AS pattern
FROM (SELECT *, lead(role, 1) OVER (PARTITION BY conv_id ORDER BY turn) AS r1, lead(role, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS r2 FROM conversations)""")
def turn_patterns(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    r = t.conversations.select("conv_id", "turn", "role", F.lead("role", 1).over(w).alias("r1"), F.lead("role", 2).over(w).alias("r2"))
    asked = (F.col("role") == "user") & (F.col("r1") == "assistant")
    return r.select("conv_id", "turn", F.when(asked & (F.col("r2") == "user"), "request-answer-reply").when(asked, "request-answer").otherwise("other").alias("pattern"))


@queries("F9", "SELECT conv_id, role, min(turn) AS first_turn, max(turn) AS last_turn, max(turn) - min(turn) + 1 AS span FROM conversations GROUP BY conv_id, role")
def turn_spans(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), (F.max("turn") - F.min("turn") + 1).alias("span"))


def clamp(n: int, least: int, most: int) -> int:
    return max(least, min(most, n))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 100) -> DataFrame:
    """One page of rows; the limit is clamped to 1..most and the order must end in a unique key."""
    return df.orderBy(*order).offset(max(0, offset)).limit(clamp(limit, 1, most))


@queries("G1 G3 G4", """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET 40""")
def priority_page(t: Tables) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3)
    return page(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), [rank, F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")], 500, 40)


@queries("G5", "SELECT event_id, value, event_type FROM events ORDER BY value DESC, ts DESC, event_id LIMIT 25")
def top_events(t: Tables) -> DataFrame:
    return t.events.orderBy(F.desc("value"), F.desc("ts"), "event_id").limit(25).select("event_id", "value", "event_type")


@queries("G6", """WITH u AS (SELECT * FROM (SELECT p_type, p_name, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS d FROM part) WHERE d = 1),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rn FROM u) WHERE rn <= 2)
SELECT p_type, p_name, p_partkey, p_retailprice FROM c ORDER BY p_retailprice DESC, p_partkey LIMIT 8""")
def top_per_category(t: Tables) -> DataFrame:
    # Repeated names go first, so that they take no place of their category.
    unique = latest_per(t.part.withColumn("low", -F.col("p_partkey")), ["p_name"], ["p_retailprice", "low"], ["p_type", "p_partkey", "p_retailprice"])
    two = ranked(unique, ["p_type"], [F.desc("p_retailprice"), F.col("p_partkey")]).filter("place <= 2")
    return two.orderBy(F.desc("p_retailprice"), "p_partkey").limit(8).select("p_type", "p_name", "p_partkey", "p_retailprice")


@queries("G8", """SELECT o_custkey, o_orderkey AS representative FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority = '1-URGENT') DESC, o_orderstatus DESC, o_totalprice DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def representatives(t: Tables) -> DataFrame:
    o = t.orders.withColumn("urgent", F.col("o_orderpriority") == "1-URGENT")
    return latest_per(o, ["o_custkey"], ["urgent", "o_orderstatus", "o_totalprice", "o_orderkey"], ["o_orderkey"]).withColumnRenamed("o_orderkey", "representative")


@queries("G9", """SELECT kind, id, weight FROM (SELECT 'order' AS kind, o_orderkey AS id, 100 AS weight FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'customer', c_custkey, 80 FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'supplier', s_suppkey, 60 FROM supplier WHERE s_acctbal < 0) ORDER BY weight DESC, id, kind LIMIT 50""")
def weighted_ranking(t: Tables) -> DataFrame:
    part = lambda df, kind, id_, weight: df.select(F.lit(kind).alias("kind"), F.col(id_).alias("id"), F.lit(weight).alias("weight"))
    rows = part(t.orders.filter("o_orderstatus = 'P'"), "order", "o_orderkey", 100).union(part(t.customer.filter("c_acctbal < 0"), "customer", "c_custkey", 80))
    return rows.union(part(t.supplier.filter("s_acctbal < 0"), "supplier", "s_suppkey", 60)).orderBy(F.desc("weight"), "id", "kind").limit(50)


@queries("G10", """SELECT user_id, string_agg(event_type, ',' ORDER BY n DESC, event_type) AS best FROM (SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE rn <= 2 GROUP BY user_id""")
def best_classes(t: Tables) -> DataFrame:
    n = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "event_type")))  # as many as there are types
    return n.groupBy("user_id").agg(F.array_join(F.transform(F.slice(listed, 1, 2), lambda x: x["event_type"]), ",").alias("best"))


@queries("G11 J5", """WITH s AS (SELECT conv_id, trim(unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1\n', 'g'), chr(10)))) AS s FROM conversations)
SELECT conv_id, s, rank FROM (SELECT conv_id, s, row_number() OVER (PARTITION BY conv_id ORDER BY length(s) DESC, s) AS rank FROM (SELECT DISTINCT conv_id, s FROM s WHERE s <> '')) WHERE rank <= 3""".replace("\\\\", "\\"))
def longest_sentences(t: Tables) -> DataFrame:
    split = t.conversations.select("conv_id", F.explode(F.split("text", r"(?<=[.!?])\s+|\n")).alias("s"))
    sentences = split.select("conv_id", F.trim("s").alias("s")).filter("s <> ''").distinct()
    return ranked(sentences, ["conv_id"], [F.desc(F.length("s")), F.col("s")], "rank").filter("rank <= 3").select("conv_id", "s", "rank")


@queries("H2 H3 H5 P1", """WITH w AS (SELECT conv_id, list_distinct(list(role)) AS roles, list_distinct(list(turn)) AS turns FROM conversations GROUP BY conv_id)
SELECT conv_id, len(list_intersect(roles, ['user', 'system'])) AS shared, len(list_distinct(list_concat(roles, ['user', 'system']))) AS either, len(list_filter(roles, lambda x: x NOT IN ('user', 'assistant'))) = 0 AS within FROM w""")
def set_operations(t: Tables) -> DataFrame:
    roles = t.conversations.groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    two, known = F.array(F.lit("user"), F.lit("system")), F.array(F.lit("user"), F.lit("assistant"))
    return roles.select("conv_id", F.size(F.array_intersect("roles", two)).cast("long").alias("shared"), F.size(F.array_union("roles", two)).cast("long").alias("either"), (F.size(F.array_except("roles", known)) == 0).alias("within"))


@queries("R9", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 250")
def last_250_events(t: Tables) -> DataFrame:
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(250).select("event_id", "user_id")


@queries("V12", """WITH c AS (SELECT conv_id, turn, role, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS n FROM conversations)
SELECT conv_id, turn, role, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM c""")
def speaker_runs(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    new = (~F.col("role").eqNullSafe(F.lag("role").over(w))).cast("long").alias("new")
    return t.conversations.select("conv_id", "turn", "role", new).select("conv_id", "turn", "role", F.sum("new").over(w).alias("run"))


@queries("V16 J13", """SELECT o_custkey, o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 4) AS BIGINT) AS batch FROM orders""")
def fixed_size_batches(t: Tables) -> DataFrame:
    return ranked(t.orders, ["o_custkey"], [F.col("o_orderkey")]).select("o_custkey", "o_orderkey", F.floor((F.col("place") - 1) / 4).alias("batch"))


@queries("V13", """SELECT name, n FROM (SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS name FROM conversations) GROUP BY name) WHERE n >= 2""")
def mentioned_names(t: Tables) -> DataFrame:
    names = t.conversations.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0))).alias("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")

