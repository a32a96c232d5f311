"""Splitting text into turns, sentences, chunks and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwork.operators import segmenting
from quillwork.plans.book import Book
from quillwork.sources.tables import Tables

queries = Book()


def _transcripts(t: Tables) -> DataFrame:
    """Each conversation as one text, a line a turn; a conversation's turns are bounded."""
    said = F.concat(F.initcap("role"), F.lit(": "), F.regexp_replace("text", r"\s+", " "))
    turns = F.sort_array(F.collect_list(F.struct("turn", said.alias("said"))))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["said"]), "\n").alias("text"))


@queries("J1 J2 J6 V19", r"""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS idx, upper(role[1]) || role[2:] AS speaker, trim(regexp_replace(text, '\s+', ' ', 'g')) AS said FROM conversations""")
def parsed_turns(t: Tables) -> DataFrame:
    turns = segmenting.parse_turns(F.col("text"))
    return _transcripts(t).select("conv_id", F.posexplode(turns).alias("idx", "turn")).select("conv_id", "idx", F.col("turn.speaker").alias("speaker"), F.col("turn.text").alias("said"))


@queries("J3")
def split_long_turns(t: Tables) -> DataFrame:
    parts = segmenting.split_long(F.col("text"), 200)
    return t.conversations.select("conv_id", "turn", F.posexplode(parts).alias("part", "said"))


@queries("J4", r"""SELECT conv_id, turn FROM (SELECT conv_id, turn, text, len(regexp_extract_all(text, '[.!?]')) AS n FROM conversations) WHERE length(text) >= 200 AND n >= 3 AND length(text) / n <= 400""")
def unlabelled_speech(t: Tables) -> DataFrame:
    n = F.regexp_count("text", F.lit("[.!?]"))
    return t.conversations.filter((F.length("text") >= 200) & (n >= 3) & (F.length("text") / n <= 400)).select("conv_id", "turn")


@queries("J5 J7", r"""WITH s AS (SELECT conv_id, turn, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n', chr(1), 'g'), '([.!?])[ \t' || chr(1) || ']+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS s FROM conversations)
SELECT conv_id, turn, s FROM s WHERE len(string_split_regex(s, '\s+')) >= 3""")
def sentence_units(t: Tables) -> DataFrame:
    s = segmenting.sentences(F.col("text"))
    units = t.conversations.select("conv_id", "turn", F.explode(s).alias("s"))
    return units.filter(F.size(F.split("s", r"\s+")) >= 3)


@queries("J8 J9")
def document_chunks(t: Tables) -> DataFrame:
    chunks = segmenting.chunk_texts(F.col("text"), 1200, 150)
    return t.documents.select("doc_id", F.posexplode_outer(chunks).alias("chunk", "said"))


@queries("J11", "SELECT conv_id, turn, CAST(floor((turn - 1) / 3) AS BIGINT) AS fixed, CAST(floor((turn + 1) / 3) AS BIGINT) AS shifted FROM conversations")
def alternative_chunkings(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.floor((F.col("turn") - 1) / 3).alias("fixed"), F.floor((F.col("turn") + 1) / 3).alias("shifted"))


@queries("J10 J12")
def repaired_boundaries(t: Tables) -> DataFrame:
    return segmenting.cover_turns(t.conversations.select("conv_id", "turn", F.length("text").alias("size")), most=3, least=2)


@queries("J13")
def packed_batches(t: Tables) -> DataFrame:
    return segmenting.batch_in_order(t.conversations.select("conv_id", "turn", F.length("text").alias("size")), most_items=8, most_size=2000)


@queries("J14 F8")
def subject_segments(t: Tables) -> DataFrame:
    return segmenting.subject_segments(t.conversations.select("conv_id", "turn", "text"), k=2, least=2)


@queries("J15 J18", r"""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages), r AS (SELECT page_id, line, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^\s*<[^>]*>\s*$') THEN 'tag' WHEN length(line) < 10 THEN 'short' ELSE 'kept' END AS reason FROM l)
SELECT page_id, count(*) FILTER (WHERE reason = 'kept') AS kept, count(*) FILTER (WHERE reason = 'blank') AS blank, count(*) FILTER (WHERE reason = 'tag') AS tag, round(coalesce(sum(length(line)) FILTER (WHERE reason = 'kept'), 0) / greatest(1, sum(length(line))), 3) AS coverage FROM r GROUP BY page_id""")
def denoised_lines(t: Tables) -> DataFrame:
    line = t.pages.select("page_id", F.explode(F.split("html", "\n")).alias("line"))
    reason = F.when(F.trim("line") == "", "blank").when(F.col("line").rlike(r"^\s*<[^>]*>\s*$"), "tag").when(F.length("line") < 10, "short").otherwise("kept")
    r = line.withColumn("reason", reason)
    n = lambda x: F.count(F.when(F.col("reason") == x, True)).alias(x)
    kept = F.coalesce(F.sum(F.when(F.col("reason") == "kept", F.length("line"))), F.lit(0))
    return r.groupBy("page_id").agg(n("kept"), n("blank"), n("tag"), F.round(kept / F.greatest(F.lit(1), F.sum(F.length("line"))), 3).alias("coverage"))


@queries("J16")
def status_clauses(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.posexplode(segmenting.clauses(F.col("text"))).alias("clause", "said"))


@queries("J17", r"""SELECT o_orderkey, 'C' || o_custkey AS owner, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS deadline FROM orders""")
def action_table_rows(t: Tables) -> DataFrame:
    # Orders as rows of a text table, one text a customer, parsed back.
    row = F.concat(F.lit("| "), "o_orderkey", F.lit(" | C"), "o_custkey", F.lit(" | "), F.to_date("o_orderdate").cast("string"), F.lit(" |"))
    tables = t.orders.groupBy("o_custkey").agg(F.concat_ws("\n", F.collect_list(row)).alias("text"))
    p = F.lit(r"(?m)^\| (\d+) \| (\w+) \| (\d{4}-\d{2}-\d{2}) \|$")
    cell = lambda i: F.regexp_extract_all("text", p, F.lit(i))
    rows = tables.select(F.inline(F.arrays_zip(cell(1).alias("a"), cell(2).alias("b"), cell(3).alias("c"))))
    names = rows.columns
    return rows.select(F.col(names[0]).cast("long").alias("o_orderkey"), F.col(names[1]).alias("owner"), F.col(names[2]).alias("deadline"))


@queries("V6 V23", r"""SELECT conv_id, turn FROM conversations WHERE NOT (lower(trim(text)) IN ('ok', 'thanks', 'yes', 'no') OR (text LIKE '%?' AND len(string_split_regex(trim(text), '\s+')) <= 8) OR len(string_split_regex(trim(text), '\s+')) <= 4)""")
def substantive_turns(t: Tables) -> DataFrame:
    n = F.size(F.split(F.trim("text"), r"\s+"))
    low = F.lower(F.trim("text")).isin("ok", "thanks", "yes", "no") | (F.endswith("text", F.lit("?")) & (n <= 8)) | (n <= 4)
    return t.conversations.filter(~low).select("conv_id", "turn")


@queries("M14", r"""WITH s AS (SELECT doc_id, sha256(trim(s)) AS h FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) WHERE length(trim(s)) > 20), g AS (SELECT h, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM s GROUP BY h HAVING count(*) > 1)
SELECT s.doc_id, count(*) AS repeats, count(*) FILTER (WHERE g.n_docs > 1) AS across FROM s JOIN g ON s.h = g.h GROUP BY s.doc_id""")
def repeated_sentences(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("s")).select("doc_id", F.trim("s").alias("s"))
    s = s.filter(F.length("s") > 20).select("doc_id", F.sha2("s", 256).alias("h"))
    # Counted by (line, document) first, so that a line of many documents isn't one task's.
    per = s.groupBy("h", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    lines = per.groupBy("h").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_docs")).filter("total > 1")
    return per.join(lines, "h").groupBy("doc_id").agg(F.sum("n").alias("repeats"), F.coalesce(F.sum(F.when(F.col("n_docs") > 1, F.col("n"))), F.lit(0)).alias("across"))


@queries("V8", r"""SELECT conv_id, turn, round(length(text) / 100.0, 2) AS size, CAST(contains(text, '?') AS INT) AS asks, CAST(regexp_matches(text, '\d') AS INT) AS counts, CAST(regexp_matches(text, '[A-Z]{2,}') AS INT) AS shouts, round(turn / max(turn) OVER (PARTITION BY conv_id), 2) AS place FROM conversations""")
def sentence_features(t: Tables) -> DataFrame:
    flag = lambda p: F.col("text").rlike(p).cast("int")
    w = Window.partitionBy("conv_id")
    return t.conversations.select("conv_id", "turn", F.round(F.length("text") / 100.0, 2).alias("size"), flag(r"\?").alias("asks"), flag(r"\d").alias("counts"), flag("[A-Z]{2,}").alias("shouts"), F.round(F.col("turn") / F.max("turn").over(w), 2).alias("place"))


@queries("V21", r"""SELECT s_suppkey, regexp_replace('Smith, ' || s_name, '^([^,]+), (.+)$', '\2 \1') AS name FROM supplier""")
def first_name_first(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.regexp_replace(F.concat(F.lit("Smith, "), "s_name"), r"^([^,]+), (.+)$", "$2 $1").alias("name"))
