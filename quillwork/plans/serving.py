"""Files, transcripts, outside calls and publishing, as queries over the tables."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.encoders import hashed
from quillwork.operators import external, publishing, transcripts
from quillwork.functions.text import words
from quillwork.operators.candidates import best_sharing
from quillwork.operators.components import gone_at_exit, shared_folder, written
from quillwork.operators.vector_cache import cached_vectors
from quillwork.plans.book import Book
from quillwork.plans.discourse import CUES, TURNS, cued_turns
from quillwork.sources import files
from quillwork.sources.tables import Tables
from quillwork.streaming import drafts

queries = Book()


@queries("A4", "SELECT n_nationkey, 'Nation ' || n_name || chr(10) || 'of region ' || n_regionkey AS text FROM nation")
def uploaded_texts(t: Tables) -> DataFrame:
    """Text files, one a nation, read back as uploads."""
    folder = shared_folder(t.spark)
    text = F.concat(F.lit("Nation "), "n_name", F.lit("\nof region "), "n_regionkey")
    t.nation.select("n_nationkey", text.alias("value")).write.partitionBy("n_nationkey").text(folder)
    key = F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey")
    return files.read_uploads(t.spark, f"{folder}/*/*.txt").filter("not unsupported").select(key, F.rtrim("text", F.lit("\n")).alias("text"))


@queries("A5", "SELECT conv_id, turn, text FROM conversations")
def word_document_texts(t: Tables) -> DataFrame:
    """Turns as Word documents, a paragraph a line, and read back."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["text"]:
                body = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
                out.append(data.getvalue())
            yield b[["conv_id", "turn"]].assign(content=out)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["conv_id", "turn"]].assign(text=[files.docx_text(bytes(c)) for c in b["content"]])

    documents = t.conversations.select("conv_id", "turn", "text").mapInPandas(packed, "conv_id long, turn long, content binary")
    return documents.mapInPandas(read, "conv_id long, turn long, text string")


@queries("A7", "SELECT text, role AS label, 'turn ' || turn AS reason, 'conv ' || conv_id AS source FROM conversations")
def training_rows(t: Tables) -> DataFrame:
    """Labelled texts as CSV with quotes and line feeds in them, read back with their four columns."""
    folder = shared_folder(t.spark)
    rows = t.conversations.select("text", F.col("role").alias("label"), F.concat(F.lit("turn "), "turn").alias("reason"), F.concat(F.lit("conv "), "conv_id").alias("source"))
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(folder)
    return files.read_training_rows(t.spark, folder)


@queries("A8", "SELECT n_nationkey AS id, n_name AS name, 1000 - n_nationkey AS created FROM nation")
def store_entries(t: Tables) -> DataFrame:
    """A store of one JSON array in one file, its entries newest first."""
    folder = shared_folder(t.spark)
    entry = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (1000 - F.col("n_nationkey")).alias("created"))
    t.nation.agg(F.to_json(F.collect_list(entry)).alias("value")).coalesce(1).write.text(folder)  # 25 nations
    return files.read_json_store(t.spark, folder, "id int, name string, created int", "created")


_NAMES = {"user": "Ann O'Neill", "assistant": "Björn Lind", "system": "priya.raman"}
_NAMED = "CASE role WHEN 'user' THEN 'Ann O''Neill' WHEN 'assistant' THEN 'Björn Lind' ELSE 'Unattributed' END"
_SPACED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_STAMP = "'0:0' || (turn % 10)"
_LINE = f"""CASE WHEN role = 'system' THEN 'priya.raman: ' || text WHEN conv_id % 4 = 2 THEN {_NAMED} || ': ' || text WHEN conv_id % 4 = 0 THEN {_NAMED} || '   ' || {_STAMP} || chr(10) || text
  WHEN conv_id % 4 = 1 THEN {_NAMED} || '   ' || {_STAMP} || text ELSE '[' || {_STAMP} || '] ' || {_NAMED} || ': ' || text END"""


def _transcripts(t: Tables) -> DataFrame:
    """Conversations as transcripts of four layouts, by number: names with a time and the words below, the same glued,
    names with a colon, and the same behind a time; a system's turns are under a handle. The texts are as they are."""
    name = F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv])[F.col("role")]
    stamp = F.concat(F.lit("0:0"), F.col("turn") % 10)
    handle, layout = F.col("role") == "system", F.col("conv_id") % 4
    said = F.when(handle | (layout == 2), F.concat(name, F.lit(": "), "text")).when(layout == 0, F.concat(name, F.lit("   "), stamp, F.lit("\n"), "text"))
    said = said.when(layout == 1, F.concat(name, F.lit("   "), stamp, "text")).otherwise(F.concat(F.lit("["), stamp, F.lit("] "), name, F.lit(": "), "text"))
    lines = F.sort_array(F.collect_list(F.struct("turn", said.alias("said"))))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["said"]), "\n").alias("text"))


@queries("J1 J2 J6", rf"""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS idx, {_NAMED} AS speaker, {_SPACED} AS said FROM conversations WHERE {_SPACED} <> ''""")
def transcript_turns(t: Tables) -> DataFrame:
    """Transcripts of four layouts read back as turns."""
    return transcripts.turns_of(_transcripts(t), "conv_id", "text")


@queries("J2", f"""WITH l AS (SELECT conv_id, turn, {_NAMED} AS speaker, length({_LINE}) AS n, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS piece, 'turn' AS kind, speaker, n + CASE WHEN turn < last THEN 1 ELSE 0 END AS chars FROM l""")
def transcript_pieces(t: Tables) -> DataFrame:
    """Where each transcript is cut: turns and unread regions, which hold all its characters."""
    found = transcripts.pieces_of(_transcripts(t), "conv_id", "text")
    return found.select("conv_id", "piece", "kind", "speaker", (F.col("end") - F.col("begin")).alias("chars"))


@queries("V19", f"""WITH {TURNS} SELECT conv_id, count(DISTINCT role) AS participants, string_agg(turn, ',' ORDER BY turn) FILTER (WHERE commits = 1) AS actions, string_agg(turn, ',' ORDER BY turn) FILTER (WHERE accepts = 1) AS decisions, string_agg(turn, ',' ORDER BY turn) FILTER (WHERE risky = 1) AS risks FROM turns GROUP BY conv_id""")
def evidence_ledger(t: Tables) -> DataFrame:
    """Who took part in a conversation, and the turns of its actions, decisions and risks."""
    listed = lambda c: F.nullif(F.array_join(F.sort_array(F.collect_list(F.when(F.col(c) == 1, F.col("turn")))).cast("array<string>"), ","), F.lit(""))
    return cued_turns(t).groupBy("conv_id").agg(F.countDistinct("role").alias("participants"), listed("commits").alias("actions"), listed("accepts").alias("decisions"), listed("risky").alias("risks"))


_SCRIPT = "import json, sys; print(json.dumps([len(t.split(' ')) for t in json.load(sys.stdin)]))"


@queries("U1", "SELECT conv_id, turn, len(string_split(text, ' ')) AS parts FROM conversations")
def script_results(t: Tables) -> DataFrame:
    """A script's answers, a process for every two hundred texts."""
    done = external.scripted(t.conversations.select("conv_id", "turn", "text"), "text", _SCRIPT)
    return done.filter("error is null").select("conv_id", "turn", F.col("answer").cast("int").alias("parts"))


#: Characters that the reader takes; a longer text is refused, as a service refuses one beyond its context.
MOST_CHARS = 400


def _extract(text: str, attempt: int) -> str:
    """A reader of texts in place of a model: how many words, and whether it asks."""
    if len(text) > MOST_CHARS:
        raise ValueError(f"{len(text)} characters")
    return json.dumps({"words": len(re.findall("[a-z0-9]+", text.lower())), "asks": "?" in text})


@queries("U2 U3 L1", f"""SELECT conv_id, turn, CASE WHEN f THEN len(regexp_extract_all(lower(text), '[a-z0-9]+')) END AS words, CASE WHEN f THEN contains(text, '?') END AS asks, CASE WHEN f THEN 1 ELSE 3 END AS attempts,
  CASE WHEN f THEN 'model' ELSE 'fallback' END AS how FROM (SELECT *, length(text) <= {MOST_CHARS} AS f FROM conversations)""")
def extracted_records(t: Tables) -> DataFrame:
    """Typed records from calls on texts: three attempts, eight in flight, and a row without an answer where all fail."""
    done = external.answered(t.conversations.select("conv_id", "turn", "text"), "text", _extract)
    record = F.from_json("answer", "words int, asks boolean")
    return done.select("conv_id", "turn", record["words"].alias("words"), record["asks"].alias("asks"), "attempts", F.when(F.col("error").isNull(), "model").otherwise("fallback").alias("how"))


@queries("U5", f"SELECT min(conv_id * 1000 + turn) AS at, 'ValueError: ' || arg_min(length(text), conv_id * 1000 + turn) || ' characters' AS error FROM conversations WHERE length(text) > {MOST_CHARS}")
def first_failed_call(t: Tables) -> DataFrame:
    """Calls run side by side, and the error told is that of the first row, not of the first to fail."""
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("at"), "text")
    return external.first_error(external.answered(rows, "text", _extract), "at")


#: Readers of one turn each: name and the cue of what it looks for.
SPECIALISTS = {"actions": "commits", "decisions": "accepts", "risks": "risky"}


def _specialist(cue: str) -> Callable[[str, int], str]:
    pattern = CUES[cue]

    def read(text: str, attempt: int) -> str:
        return json.dumps(re.search(pattern, text.lower(), re.ASCII) is not None)  # word bounds are those of SQL

    return read


@queries("U4", f"""WITH {TURNS} SELECT conv_id, turn, specialist, CASE WHEN hit = 1 THEN 'found' ELSE 'nothing' END AS outcome, true AS complete
  FROM turns, LATERAL (VALUES {', '.join(f"('{name}', {cue})" for name, cue in SPECIALISTS.items())}) AS v(specialist, hit)""")
def specialists(t: Tables) -> DataFrame:
    """Three readers asked about each turn's whole text at once, none waiting for another; what one finds stays if another fails."""
    turns = t.conversations.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("said"))
    asked = external.fanned_out(turns, "said", {name: _specialist(cue) for name, cue in SPECIALISTS.items()}, in_flight=12)
    one = asked.select("conv_id", "turn", "complete", F.explode("answers").alias("a"))
    outcome = F.when(F.col("a.error").isNotNull(), "failed").when(F.col("a.answer") == "true", "found").otherwise("nothing")
    return one.select("conv_id", "turn", F.col("a.call").alias("specialist"), outcome.alias("outcome"), "complete")


@queries("B14", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 422 ELSE 200 END AS status FROM orders")
def posted_orders(t: Tables) -> DataFrame:
    """Orders posted in batches of one status; the receiver refuses those that are pending."""
    post = lambda records: 422 if records[0]["o_orderstatus"] == "P" else 200
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    sent = [external.posted(rows.filter(F.col("o_orderstatus") == s if s else ~F.col("o_orderstatus").isin("P")), post) for s in ("P", None)]
    return sent[0].union(sent[1]).select("o_orderkey", "status")


@queries("B12", "SELECT c.c_custkey, coalesce(o.n, 0) AS n FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey")
def published_tables(t: Tables) -> DataFrame:
    """Two tables written as one version and read through its manifest."""
    folder = shared_folder(t.spark)
    counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    version = publishing.publish(t.spark, folder, {"customers": t.customer.select("c_custkey"), "counts": counts})
    read = lambda name: publishing.published(t.spark, folder, name, version)
    return read("customers").join(read("counts"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@queries("R3", r"SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '\S') THEN 'done' ELSE 'failed' END AS state, CASE WHEN regexp_matches(coalesce(text, ''), '\S') THEN 1 ELSE 3 END AS attempts, CASE WHEN regexp_matches(coalesce(text, ''), '\S') THEN 16 END AS size FROM documents")
def embedding_jobs(t: Tables) -> DataFrame:
    """Jobs of an embedding worker: each text's vector, or failed after three attempts, as one without a word is."""

    def embed(text: str, attempt: int) -> str:
        (v,) = hashed([text], 16)
        if not text.split():
            raise ValueError("no word")
        return json.dumps(v)

    done = external.answered(t.documents.select("doc_id", "text"), "text", embed, in_flight=20)
    vector = F.from_json("answer", "array<double>")
    return done.select("doc_id", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("state"), "attempts", F.when(F.col("error").isNull(), F.size(vector)).alias("size"))


@queries("L1")
def cached_embeddings(t: Tables) -> DataFrame:
    """Vectors of all documents by a folder of vectors, in two runs: the second encodes only texts that the first hadn't."""
    folder = f"{shared_folder(t.spark)}/vectors"
    docs = t.documents.select("doc_id", "text")
    first = cached_vectors(docs.filter("doc_id % 2 = 0"), "text", folder, 384)
    second = cached_vectors(docs.filter("doc_id % 2 <> 0 or doc_id is null"), "text", folder, 384)
    gone_at_exit(t.spark, folder)
    return first.unionByName(second).select("doc_id", F.hex("content").alias("content"), "encoder", "vector")


@queries("U6", """WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS t FROM benchmark), x AS (SELECT item_id, unnest(list_sort(t)[1:12]) AS w FROM q), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}'))) AS w FROM documents),
s AS (SELECT item_id, doc_id, count(*) AS score FROM x JOIN d USING (w) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS place FROM s),
l AS (SELECT r.item_id, r.place, r.doc_id, i - 1 AS line, ls[i] AS said FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) k JOIN r ON r.doc_id = k.doc_id AND r.place <= 3, LATERAL (SELECT unnest(generate_series(1, len(ls))) AS i)),
o AS (SELECT l.*, len(list_intersect(list_distinct(regexp_extract_all(lower(said), '[a-z0-9]{4,}')), q.t)) AS shared FROM l JOIN q USING (item_id)), b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, place, line) AS rn FROM o WHERE shared > 0)
SELECT q.item_id, b.doc_id, CAST(b.line AS INT) AS line, CAST(b.shared AS INT) AS shared, sha256(trim(b.said)) AS answer_sha256 FROM q LEFT JOIN b ON b.item_id = q.item_id AND b.rn = 1""")
def answers_with_sources(t: Tables) -> DataFrame:
    """What is retrieved is read: of the three documents with most of an item's words, the line that holds most of them is its
    answer, with its source."""
    tokens = lambda c: F.array_distinct(words(F.col(c), 4))
    asked = written(t.benchmark.select(F.col("item_id").alias("item"), tokens("text").alias("all_words")))
    docs = t.documents.select(F.col("doc_id").alias("row"), tokens("text").alias("words"))
    three, _ = best_sharing(asked.select("item", F.slice(F.sort_array("all_words"), 1, 12).alias("words")), docs, 3, F.desc("row"))
    # Three documents an item: their names go to where the texts are, if they are few.
    lines = t.documents.join(three, F.col("doc_id") == F.col("row")).select("item", "place", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    shared = F.size(F.array_intersect(tokens("said"), "all_words")).alias("shared")
    o = lines.join(asked, "item").select("item", "place", "doc_id", "line", "said", shared).filter("shared > 0")
    best = o.groupBy("item").agg(F.min(F.struct((-F.col("shared")).alias("low"), "place", "line", "doc_id", F.sha2(F.trim("said"), 256).alias("answer"))).alias("b"))
    return asked.join(best, "item", "left").select(F.col("item").alias("item_id"), "b.doc_id", "b.line", (-F.col("b.low")).alias("shared"), F.col("b.answer").alias("answer_sha256"))


@queries("R8", """WITH e AS (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM e), f AS (SELECT user_id, CAST(sid AS BIGINT) AS sid, substr(sha256(string_agg(event_type, ',' ORDER BY ts, event_id)), 1, 16) AS print FROM s GROUP BY 1, 2)
SELECT user_id, sid, print, coalesce(print <> lag(print) OVER (PARTITION BY user_id ORDER BY sid), true) AS stale FROM f""")
def session_fingerprints(t: Tables) -> DataFrame:
    """Sessions by an idle gap of six hours; what was computed ahead is stale where a session's fingerprint
    isn't that of the session before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.lag("ts").over(w).isNull() | (F.col("ts") > F.lag("ts").over(w) + F.expr("interval 6 hours"))
    e = t.events.select("user_id", "ts", "event_id", "event_type", gap.cast("long").alias("new")).withColumn("sid", F.sum("new").over(w))
    kinds = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]), ",")
    f = e.groupBy("user_id", "sid").agg(F.substring(F.sha2(kinds, 256), 1, 16).alias("print"))
    before = F.lag("print").over(Window.partitionBy("user_id").orderBy("sid"))
    return f.select("user_id", "sid", "print", F.coalesce(F.col("print") != before, F.lit(True)).alias("stale"))


@queries("R8 R10", f"""WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'write' WHEN 'view' THEN 'ahead' ELSE 'ask' END AS kind, value FROM events WHERE event_type IN ('purchase', 'view', 'click')),
v AS (SELECT *, count(*) FILTER (WHERE kind = 'write') OVER w AS version, last_value(CASE WHEN kind = 'write' THEN value END IGNORE NULLS) OVER w AS held FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT *, last_value(CASE WHEN kind = 'ahead' THEN version END IGNORE NULLS) OVER w AS spec_version, last_value(CASE WHEN kind = 'ahead' THEN ts END IGNORE NULLS) OVER w AS spec_ts FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, version, round(held, 4) AS held, CASE WHEN kind <> 'ask' THEN kind WHEN spec_version IS NULL THEN 'fresh' WHEN spec_version <> version THEN 'stale' WHEN ts > spec_ts + INTERVAL {drafts.TTL_S} SECOND THEN 'expired' ELSE 'used' END AS outcome FROM a""")
def drafts_replayed(t: Tables) -> DataFrame:
    """Each draft's writes applied one by one, and whether an answer that was computed ahead may be used: not if a
    write came since (stale) nor after its time (expired). The stream in ``streaming/drafts.py`` gives the same rows."""
    kind = F.when(F.col("event_type") == "purchase", "write").when(F.col("event_type") == "view", "ahead").otherwise("ask")
    e = t.events.filter("event_type in ('purchase', 'view', 'click')").select(F.col("user_id").alias("draft"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"), "value")
    return drafts.replayed(e).select(F.col("draft").alias("user_id"), F.col("seq").alias("event_id"), "version", F.round("held", 4).alias("held"), "outcome")


@queries("R10", "SELECT user_id, event_type, count(*) AS writes, arg_max(event_id, (ts, event_id)) AS last_write, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def serial_writes(t: Tables) -> DataFrame:
    """Writes of a key applied one after another: how many there were, and what the last one left."""
    order = F.struct("ts", "event_id")
    return t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("writes"), F.max_by("event_id", order).alias("last_write"), F.max_by("value", order).alias("value"))
