"""Aggregations: counts, histograms, distributions, nested lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.text import words
from quillwork.operators.latest import latest_per
from quillwork.operators.ranks import nearest_rank, ranked_values
from quillwork.plans.book import Book
from quillwork.sources.tables import Tables

queries = Book()


@queries("E1", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O'")
def total_rows(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'O'").agg(F.count(F.lit(1)).alias("total"))


@queries("E2 I32", """SELECT event_type, count(*) AS n, CAST(min(ts) AS VARCHAR) AS oldest, CAST(max(ts) AS VARCHAR) AS newest, CAST(floor(epoch(TIMESTAMP '2024-02-01') - epoch(min(ts))) AS BIGINT) AS oldest_age FROM (SELECT event_type, date_trunc('second', ts) AS ts FROM events) GROUP BY event_type""")
def queue_status(t: Tables) -> DataFrame:
    e = t.events.select("event_type", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    now = F.unix_timestamp(F.lit("2024-02-01 00:00:00"))
    said = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), said(F.min("ts")).alias("oldest"), said(F.max("ts")).alias("newest"), (now - F.unix_timestamp(F.min("ts"))).alias("oldest_age"))


@queries("E3", """SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_done, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_pending, count(*) AS n FROM orders GROUP BY o_custkey""")
def status_pivot(t: Tables) -> DataFrame:
    n = lambda s, name: F.count(F.when(F.col("o_orderstatus") == s, True)).alias(name)
    return t.orders.groupBy("o_custkey").agg(n("O", "n_open"), n("F", "n_done"), n("P", "n_pending"), F.count(F.lit(1)).alias("n"))


@queries("E4 E15", """SELECT s.status, coalesce(c.n, 0) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(status) LEFT JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) c ON c.o_orderstatus = s.status""")
def board_counts(t: Tables) -> DataFrame:
    domain = t.spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], "status string")
    counts = t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return domain.join(counts, "status", "left").fillna(0, "n")


@queries("E5", "SELECT l_orderkey, max(l_linenumber) + 1 AS next_line FROM lineitem GROUP BY l_orderkey")
def next_sort_order(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg((F.max("l_linenumber") + 1).alias("next_line"))


@queries("E6 E8", """SELECT c_custkey, coalesce(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderdate DESC, o_orderkey DESC), '') AS versions FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def nested_versions(t: Tables) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")), asc=False)
    said = F.array_join(F.transform(listed, lambda x: F.concat(x["o_orderkey"], F.lit(":"), x["o_orderstatus"])), ",")
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(said.alias("versions"))
    return t.customer.select("c_custkey").join(per, "c_custkey", "left").fillna("", "versions")


@queries("E7 O5", """SELECT o_custkey, string_agg(o_orderkey || '[' || lines || ']', ';' ORDER BY o_orderkey) AS reports FROM (SELECT o_custkey, o_orderkey, string_agg(l_linenumber || l_linestatus, ',' ORDER BY l_linenumber, l_linestatus) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY o_custkey""")
def doubly_nested(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_linestatus"))).alias("lines"))
    said = F.array_join(F.transform("lines", lambda x: F.concat(x["l_linenumber"], x["l_linestatus"])), ",")
    per_order = t.orders.join(lines, "o_orderkey").select("o_custkey", "o_orderkey", said.alias("lines"))
    reports = F.sort_array(F.collect_list(F.struct("o_orderkey", "lines")))
    return per_order.groupBy("o_custkey").agg(F.array_join(F.transform(reports, lambda x: F.concat(x["o_orderkey"], F.lit("["), x["lines"], F.lit("]"))), ";").alias("reports"))


@queries("E9", """SELECT user_id % 10 AS stage, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS by_type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, event_type, count(*) AS n FROM (SELECT user_id % 10 AS user_id, event_type FROM events) GROUP BY 1, 2) GROUP BY 1""")
def two_level_histogram(t: Tables) -> DataFrame:
    counts = t.events.groupBy((F.col("user_id") % 10).alias("stage"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    listed = F.sort_array(F.collect_list(F.struct("event_type", "n")))
    said = F.array_join(F.transform(listed, lambda x: F.concat(x["event_type"], F.lit("="), x["n"])), ",")
    return counts.groupBy("stage").agg(said.alias("by_type"), F.sum("n").alias("n"))


@queries("E10", """SELECT user_id, count(*) FILTER (WHERE regexp_matches(event_type, '^(click|view)$')) AS n_seen, count(*) FILTER (WHERE regexp_matches(event_type, 'purchase')) AS n_bought, count(*) FILTER (WHERE regexp_matches(event_type, 'err')) AS n_errors FROM events GROUP BY user_id""")
def conditional_counters(t: Tables) -> DataFrame:
    n = lambda p, name: F.count(F.when(F.col("event_type").rlike(p), True)).alias(name)
    return t.events.groupBy("user_id").agg(n("^(click|view)$", "n_seen"), n("purchase", "n_bought"), n("err", "n_errors"))


@queries("E11", """SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, min(value) AS least, max(value) AS most, count(value) AS n FROM events GROUP BY event_type""")
def nearest_rank_percentiles(t: Tables) -> DataFrame:
    p = ranked_values(t.events, ["event_type"], "value", {f"p{int(q * 100)}": nearest_rank(q) for q in (0.5, 0.9, 0.95)}).withColumnRenamed("event_type", "of")
    ends = t.events.groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("n"))
    return ends.join(p, F.col("event_type").eqNullSafe(F.col("of")), "left").drop("of")


@queries("E12 E13", """SELECT event_type AS stage, CAST(json_extract_string(props, '$.k') AS INT) % 3 AS pass, count(*) AS calls, count(*) FILTER (WHERE value > 50) AS slow, CAST(sum(greatest(0, CAST(json_extract_string(props, '$.k') AS INT) - 1)) AS BIGINT) AS retries, quantile_disc(value, 0.5) AS p50, count(DISTINCT user_id) AS journeys FROM events GROUP BY 1, 2""")
def performance_summary(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = t.events.select(F.col("event_type").alias("stage"), (k % 3).alias("pass"), k.alias("k"), "value", "user_id")
    # Journeys are counted once they are one row each; no group's rows or values meet in one task.
    by_user = e.groupBy("stage", "pass", "user_id").agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("value") > 50, True)).alias("slow"), F.sum(F.greatest(F.lit(0), F.col("k") - 1)).alias("retries"))
    sums = by_user.groupBy("stage", "pass").agg(*[F.sum(c).alias(c) for c in ("calls", "slow", "retries")], F.count("user_id").alias("journeys"))
    p50 = ranked_values(e, ["stage", "pass"], "value", {"p50": nearest_rank(0.5)}).withColumnsRenamed({"stage": "s", "pass": "p"})
    return sums.join(p50, F.col("stage").eqNullSafe(F.col("s")) & F.col("pass").eqNullSafe(F.col("p")), "left").drop("s", "p")


@queries("E14", """WITH t AS (SELECT source, unnest(list_distinct([lang, source, lang])) AS tag FROM documents) SELECT tag, count(*) AS n, count(*) FILTER (WHERE source = 'src0') AS n_open FROM t GROUP BY tag""")
def tag_counts(t: Tables) -> DataFrame:
    tags = t.documents.select("source", F.explode(F.array_distinct(F.array("lang", "source", "lang"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("source") == "src0", True)).alias("n_open"))


@queries("E16", """SELECT o_custkey, arg_max(o_orderstatus, n * 100 - ascii(o_orderstatus)) AS vote, round(greatest(0.3, least(0.99, max(n) / sum(n) - CASE WHEN count(*) > 1 THEN 0.1 ELSE 0 END)), 2) AS confidence
FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY o_custkey""")
def vote_confidence(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    share = F.max("n") / F.sum("n") - F.when(F.count(F.lit(1)) > 1, 0.1).otherwise(0.0)
    confidence = F.round(F.greatest(F.lit(0.3), F.least(F.lit(0.99), share)), 2)
    return n.groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.col("n") * 100 - F.ascii("o_orderstatus")).alias("vote"), confidence.alias("confidence"))


STOP = ("that", "this", "with", "from", "have")


@queries("E17 H4", """WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w WHERE word NOT IN ('that', 'this', 'with', 'from', 'have') GROUP BY 1, 2)
SELECT lang, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 12""")
def top_keywords(t: Tables) -> DataFrame:
    word = F.explode(F.filter(words(F.col("text"), 4), lambda x: ~x.isin(*STOP)))
    counts = t.documents.select("lang", word.alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", place).filter("rank <= 12").select("lang", "word", "n", "rank")


@queries("E19", """SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM documents) GROUP BY token""")
def document_frequency(t: Tables) -> DataFrame:
    return t.documents.select(F.explode(F.array_distinct(words(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@queries("E20 N12", """WITH p AS (SELECT conv_id, role, count(*) AS n, count(*) FILTER (WHERE length(text) >= 80) AS long FROM conversations GROUP BY 1, 2)
SELECT conv_id, round(max(n) / sum(n), 3) AS dominance, round(sum(long) / sum(n), 3) AS substantive, CASE WHEN sum(n) < 3 THEN 'sparse' WHEN max(n) / sum(n) > 0.8 THEN 'unreliable' ELSE 'healthy' END AS health FROM p GROUP BY conv_id""")
def transcript_health(t: Tables) -> DataFrame:
    per = t.conversations.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.length("text") >= 80, True)).alias("long"))
    share = F.max("n") / F.sum("n")
    health = F.when(F.sum("n") < 3, "sparse").when(share > 0.8, "unreliable").otherwise("healthy")
    return per.groupBy("conv_id").agg(F.round(share, 3).alias("dominance"), F.round(F.sum("long") / F.sum("n"), 3).alias("substantive"), health.alias("health"))


@queries("E22", "SELECT event_type, round(median(value), 6) AS middle FROM events GROUP BY event_type")
def median_value(t: Tables) -> DataFrame:
    n = F.col("n")
    two = ranked_values(t.events, ["event_type"], "value", {"low": F.floor((n + 1) / 2), "high": F.floor(n / 2) + 1})
    return two.select("event_type", F.round((F.col("low") + F.col("high")) / 2, 6).alias("middle"))


@queries("E23 Q6", """SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 4) AS score, round(sum(l_discount * l_quantity) / sum(l_quantity), 4) >= 0.05 AS passed FROM lineitem GROUP BY l_suppkey""")
def weighted_score(t: Tables) -> DataFrame:
    score = F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 4)
    return t.lineitem.groupBy("l_suppkey").agg(score.alias("score"), (score >= 0.05).alias("passed"))


@queries("E24 F2 Q7", """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)
SELECT user_id % 5 AS source, count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS kept, round(count(*) FILTER (WHERE event_type = 'purchase') / count(*), 4) AS rate FROM l GROUP BY 1""")
def kept_rate_by_source(t: Tables) -> DataFrame:
    last = latest_per(t.events, ["user_id"], ["ts", "event_id"], ["event_type"])
    kept = F.count(F.when(F.col("event_type") == "purchase", True))
    return last.groupBy((F.col("user_id") % 5).alias("source")).agg(F.count(F.lit(1)).alias("total"), kept.alias("kept"), F.round(kept / F.count(F.lit(1)), 4).alias("rate"))
