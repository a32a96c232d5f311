"""Work queues and event streams: the batch form of each as a query, the live form in ``streaming``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwork.plans.book import Book
from quillwork.sources.tables import Tables
from quillwork.streaming import queue

queries = Book()
#: Ids of a range that is numbered by one task.
ID_RANGE = 10_000


@queries("R1 R2", """WITH j AS (SELECT event_id, event_type, ts, user_id % 4 AS attempts FROM events WHERE event_type IN ('click', 'view') AND ts < TIMESTAMP '2024-01-20'), d AS (SELECT * FROM j WHERE attempts < 3)
SELECT event_id, event_type, slot FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS slot FROM d) WHERE slot <= 20""")
def dispatch_plan(t: Tables) -> DataFrame:
    jobs = t.events.filter("event_type in ('click', 'view')").withColumn("attempts", F.col("user_id") % 4)
    return queue.due(jobs, "ts", "event_id", now="2024-01-20 00:00:00", most_attempts=3, each=20, key="event_type").select("event_id", "event_type", "slot")


@queries("R3", """SELECT doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 20) AS BIGINT) AS batch, source FROM documents""")
def embedding_batches(t: Tables) -> DataFrame:
    # Numbered within ranges of ids, to which the counts of the ranges before are added: a hot source is many tasks'.
    docs = t.documents.select("doc_id", "source", F.floor(F.col("doc_id") / ID_RANGE).alias("range"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = docs.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n")).select(F.col("source").alias("of"), F.col("range").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("source", "range").orderBy("doc_id"))
    numbered = docs.withColumn("place", place).join(counts, F.col("source").eqNullSafe(F.col("of")) & F.col("range").eqNullSafe(F.col("at")))
    return numbered.select("doc_id", F.floor((F.col("offset") + F.col("place") - 1) / 20).alias("batch"), "source")


@queries("R4 R5 R6")
def job_states(t: Tables) -> DataFrame:
    """Each user's events as the transitions of one job: retries with delay, lost leases, progress."""
    return queue.fold_jobs(t.events.select(F.col("user_id").alias("job"), "ts", "event_id", "event_type", "value"))


@queries("R7", """SELECT user_id, event_type, min(event_id) AS kept FROM events GROUP BY 1, 2""")
def idempotent_enqueue(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("kept"))


@queries("R8 R10", """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT user_id, CAST(epoch(date_trunc('second', min(ts))) AS BIGINT) AS started, count(*) AS n FROM s GROUP BY user_id, sid""")
def idle_sessions(t: Tables) -> DataFrame:
    e = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    # A session that ends exactly where the next event falls includes it, as in the SQL.
    s = e.groupBy("user_id", F.session_window("ts", "6 hours 1 microsecond").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))
    return s.select("user_id", F.unix_timestamp("first").alias("started"), "n")


@queries("U1 U2 U5")
def embedded_texts(t: Tables) -> DataFrame:
    """A text encoder as an operator: hashed words as unit vectors where no model answers, one call a
    batch; the result says which encoder was used."""
    from quillwork.functions.encoders import encode

    return encode(t.benchmark.select("item_id", "text"), "text", 16)
