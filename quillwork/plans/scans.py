"""Scans, projections and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions.text import contains_ignoring_case, words
from quillwork.plans.book import Book
from quillwork.sources.files import is_valid_text, log_events, recordset
from quillwork.sources.tables import Tables

queries = Book()


@queries("A1 C1", "SELECT o_orderkey AS report_id, o_custkey AS project_id, o_orderstatus AS status, round(o_totalprice, 2) AS total FROM orders WHERE o_totalprice > 100000")
def order_projection(t: Tables) -> DataFrame:
    o = t.orders.filter("o_totalprice > 100000")
    return o.select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("project_id"), F.col("o_orderstatus").alias("status"), F.round("o_totalprice", 2).alias("total"))


@queries("A3 A11", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def event_recordset(t: Tables) -> DataFrame:
    # The props of each event as a JSON array of one record, expanded to typed rows.
    as_array = t.events.select("event_id", "event_type", F.from_json(F.concat(F.lit("["), "props", F.lit("]")), "array<struct<k:int>>").alias("records"))
    return as_array.select("event_id", "event_type", F.inline("records")).filter("k is not null").select("event_id", "k", "event_type")


@queries("A4 A6", "SELECT doc_id, length(text) AS n FROM documents WHERE length(trim(text)) > 0 AND length(text) <= 2097152")
def valid_uploads(t: Tables) -> DataFrame:
    return t.documents.filter(is_valid_text(F.col("text"))).select("doc_id", F.length("text").cast("long").alias("n"))


@queries("A9", "SELECT event_type AS event, event_id AS id, value FROM events WHERE event_type LIKE 'p%' OR event_type LIKE 'e%'")
def log_event_scan(t: Tables) -> DataFrame:
    log = t.events.select(F.concat(F.lit("INFO worker "), F.to_json(F.struct(F.col("event_type").alias("event"), F.col("event_id").alias("id"), "value"))).alias("value"))
    broken = t.spark.createDataFrame([("INFO no object",), ("WARN {not json",)], "value string")
    return log_events(log.union(broken), "event string, id long, value double", "^[pe]")


@queries("A10 D9", """WITH seeds(code, weight) AS (VALUES ('F', 3), ('O', 2), ('P', 1))
SELECT code, weight, c.n AS n_orders FROM seeds, (SELECT count(*) AS n FROM orders) c""")
def seed_rows_with_total(t: Tables) -> DataFrame:
    seeds = t.spark.createDataFrame([("F", 3), ("O", 2), ("P", 1)], "code string, weight int")
    # One row of totals, joined on a constant: no cross product of tables.
    total = t.orders.agg(F.count(F.lit(1)).alias("n_orders")).withColumn("one", F.lit(1))
    return seeds.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("code", "weight", "n_orders")


@queries("C2", """SELECT json_object('id', n_nationkey, 'name', n_name, 'region', json_object('id', r_regionkey, 'name', r_name)) AS doc
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def nation_documents(t: Tables) -> DataFrame:
    region = F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    doc = F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), region.alias("region")))
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(doc.alias("doc"))


def filtered_events(events: DataFrame, event_type: str | None = None, user_id: int | None = None, least: float | None = None, since: str | None = None) -> DataFrame:
    """Only the arguments that are given filter."""
    tests = []
    if event_type is not None:
        tests.append(F.col("event_type") == event_type)
    if user_id is not None:
        tests.append(F.col("user_id") == user_id)
    if least is not None:
        tests.append(F.col("value") >= least)
    if since is not None:
        tests.append(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    return events.filter(reduce(lambda a, b: a & b, tests)) if tests else events


@queries("C3 C4", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value >= 20 AND ts >= TIMESTAMP '2024-01-10'")
def optional_filters(t: Tables) -> DataFrame:
    return filtered_events(t.events, "purchase", least=20, since="2024-01-10").select("event_id", "user_id", "value")


@queries("C5", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def enum_filter(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderstatus").isin("O", "P") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@queries("C6", "SELECT doc_id, source FROM documents WHERE contains(lower(text), lower('The_')) OR contains(lower(text), lower('Onth'))")
def substring_search(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.filter(contains_ignoring_case(text, "The_") | contains_ignoring_case(text, "Onth")).select("doc_id", "source")


@queries("C7", "SELECT event_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 15 MINUTE AND ts >= TIMESTAMP '2024-01-15 00:00:00'")
def stale_events(t: Tables) -> DataFrame:
    now = "2024-01-15 12:00:00"
    return t.events.filter(f"ts < timestamp_ntz '{now}' - interval 15 minutes and ts >= timestamp_ntz '2024-01-15 00:00:00'").select("event_id", "event_type")


@queries("C8", "SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def json_path_filter(t: Tables) -> DataFrame:
    return t.events.filter(F.get_json_object("props", "$.k") == "7").select("event_id", "user_id")


@queries("C9 D7", "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def exists_filter(t: Tables) -> DataFrame:
    pending = t.orders.filter("o_orderstatus = 'P'")
    return t.customer.join(pending, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@queries("C10", """SELECT doc_id, source FROM documents d WHERE source = 'src0' OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)""")
def approved_sources(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "source")
    own, derived = docs.filter("source = 'src0'"), docs.filter("source <> 'src0' or source is null")
    return own.union(derived.join(t.labels.filter("quality = 1"), "doc_id", "left_semi"))


@queries("C11", """SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant') AND turn BETWEEN 1 AND 4 AND contains(lower(text), 'the')""")
def facet_filter(t: Tables) -> DataFrame:
    c = t.conversations.filter(F.col("role").isin("user", "assistant") & F.col("turn").between(1, 4))
    return c.filter(contains_ignoring_case(F.col("text"), "the")).select("conv_id", "turn", "role")


#: Families of cues by role: ours, over words that the test texts have.
ROLE_CUES = {"question": r"\?", "listing": r"\|", "naming": r"\b(the|der|la|le)\b", "linking": r"\b(and|und|et|y)\b", "placing": r"\b(in|im|en|dans)\b", "asking": r"\b(is|ist|es|est)\b"}


@queries("C12", """SELECT conv_id, turn, concat_ws(',', CASE WHEN regexp_matches(l, '\\?') THEN 'question' END, CASE WHEN regexp_matches(l, '\\|') THEN 'listing' END,
CASE WHEN regexp_matches(l, '\\b(the|der|la|le)\\b') THEN 'naming' END, CASE WHEN regexp_matches(l, '\\b(and|und|et|y)\\b') THEN 'linking' END,
CASE WHEN regexp_matches(l, '\\b(in|im|en|dans)\\b') THEN 'placing' END, CASE WHEN regexp_matches(l, '\\b(is|ist|es|est)\\b') THEN 'asking' END) AS roles
FROM (SELECT conv_id, turn, regexp_replace(lower(text), '[^\\x00-\\x7F]', '_', 'g') AS l FROM conversations)""".replace("\\\\", "\\"))
def role_tags(t: Tables) -> DataFrame:
    low = F.regexp_replace(F.lower("text"), r"[^\x00-\x7F]", "_")
    roles = F.filter(F.array(*[F.when(low.rlike(p), F.lit(r)) for r, p in ROLE_CUES.items()]), lambda x: x.isNotNull())
    return t.conversations.select("conv_id", "turn", F.array_join(roles, ",").alias("roles"))


NOISE = ("ok", "yes", "the", "and", "of", "to", "in", "a")


@queries("C13", """SELECT conv_id, turn FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations)
WHERE len(w) = 0 OR (len(w) <= 2 AND len(list_filter(w, lambda x: x NOT IN ('ok', 'yes', 'the', 'and', 'of', 'to', 'in', 'a'))) = 0)""")
def noise_turns(t: Tables) -> DataFrame:
    w = words(F.col("text"))
    return t.conversations.filter((F.size(w) == 0) | ((F.size(w) <= 2) & F.forall(w, lambda x: x.isin(*NOISE)))).select("conv_id", "turn")
