"""Scalar functions over text, dates and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions import dates, phrases
from quillwork.functions.text import key, label, replace_words, sentence_case, spaced, word_count
from quillwork.plans.book import Book
from quillwork.sources.tables import Tables

queries = Book()


@queries("I1 I2 I3", """SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS spaced, trim(regexp_replace(lower(trim(source || '-' || lang)), '[^a-z0-9]+', '_', 'g'), '_') || CASE WHEN lang = 'en' THEN '' ELSE '_' || lang END AS k FROM documents""".replace("\\\\", "\\"))
def normal_forms(t: Tables) -> DataFrame:
    scoped = F.concat(key(F.concat("source", F.lit("-"), "lang")), F.when(F.col("lang") == "en", "").otherwise(F.concat(F.lit("_"), "lang")))
    return t.documents.select("doc_id", spaced(F.col("text")).alias("spaced"), scoped.alias("k"))


@queries("I4", "SELECT s_suppkey, coalesce(nullif(trim(CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE s_name END), ''), 'Report ' || s_suppkey) AS title FROM supplier")
def report_labels(t: Tables) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise(F.col("s_name"))
    return t.supplier.select("s_suppkey", label(name, F.concat(F.lit("Report "), F.col("s_suppkey"))).alias("title"))


@queries("I5", "SELECT item_id, CASE WHEN length(text) = 0 THEN '' WHEN regexp_matches(text, '[.!?]$') THEN upper(text[1]) || text[2:] ELSE upper(text[1]) || text[2:] || '.' END AS s FROM benchmark")
def sentence_cased(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", sentence_case(F.col("text")).alias("s"))


SWAPS = {"the": "tha", "of": "ov", "and": "ant"}


@queries("I6 I30", r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '\band\b', 'ant', 'g'), '\bthe\b', 'tha', 'g'), '\bof\b', 'ov', 'g') AS s FROM (SELECT conv_id, turn, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') AS text FROM conversations)""")
def spelling_swaps(t: Tables) -> DataFrame:
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "_")
    return t.conversations.select("conv_id", "turn", replace_words(plain, SWAPS).alias("s"))


@queries("I7", "SELECT event_id, json_object('k', CAST(json_extract_string(props, '$.k') AS INT), 'event_type', upper(event_type)) AS payload FROM events")
def mapped_payload(t: Tables) -> DataFrame:
    props = F.from_json("props", "struct<k:int>")
    return t.events.select("event_id", F.to_json(F.struct(props["k"].alias("k"), F.upper("event_type").alias("event_type"))).alias("payload"))


@queries("I8", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9'']+')) AS INT) AS n FROM documents")
def word_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", word_count(F.col("text")).alias("n"))


@queries("I9", r"""SELECT conv_id, turn, s FROM (SELECT conv_id, turn, regexp_extract(text, '^(.*\S)\s+((?:\S+\s+){1,5}\S*\?)$', 1) AS s FROM conversations) WHERE s <> '' AND len(string_split_regex(s, '\s+')) >= 4""")
def trailing_questions(t: Tables) -> DataFrame:
    c = t.conversations.select("conv_id", "turn", phrases.without_trailing_question(F.col("text")).alias("s"))
    return c.filter("s is not null")


@queries("I10 I11 V17")
def numeric_facts(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", phrases.digits(F.col("text")).alias("text"))
    return d.select("doc_id", phrases.quantities(F.col("text")).alias("facts")).filter(F.size("facts") > 0)


@queries("I12 I14 I27 I29")
def rewritten_phrases(t: Tables) -> DataFrame:
    said = phrases.expand_contractions(F.col("text"))
    return t.conversations.select("conv_id", "turn", phrases.team_voice(phrases.pounds(dates.plain_dates(said))).alias("s"))


@queries("I13", """WITH t AS (SELECT o_orderkey, CAST(day(o_orderdate) % 28 + 1 AS INT) AS a, CAST(day(o_orderdate) * 7 % 28 + 1 AS INT) AS b, month(o_orderdate) AS m FROM orders)
SELECT o_orderkey, CASE WHEN a <= b THEN make_date(2024, m, a) ELSE CAST(make_date(2024, m, 1) - INTERVAL 1 MONTH AS DATE) + (a - 1) END AS range_start, make_date(2024, m, b) AS range_end FROM t""")
def day_ranges(t: Tables) -> DataFrame:
    """Both ends of ranges such as '27 to 7 August'."""
    first, last = F.day("o_orderdate") % 28 + 1, F.day("o_orderdate") * 7 % 28 + 1
    month = F.date_format(F.make_date(F.lit(2024), F.month("o_orderdate"), F.lit(1)), "MMMM")
    start, end = dates.expand_range(F.concat(first, F.lit(" to "), last, F.lit(" "), month), 2024)
    return t.orders.select("o_orderkey", start.alias("range_start"), end.alias("range_end"))


@queries("I17 V22", r"""SELECT event_id, CASE WHEN event_id % 31 = 0 OR event_id % 31 > 29 THEN NULL ELSE make_date(2024, 2, CAST(event_id % 31 AS INT)) END AS d FROM events""")
def valid_dates(t: Tables) -> DataFrame:
    said = F.format_string("2024-02-%02d", F.col("event_id") % 31)
    return t.events.select("event_id", dates.strict_date(said).alias("d"))


@queries("I18", """SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%A') <> 'Monday' AS contradicts FROM orders""")
def weekday_contradictions(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    said = F.concat(F.lit("Monday "), F.date_format(day, "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", dates.weekday_contradicts(said).alias("contradicts"))


@queries("I19", """SELECT o_orderkey, 'Q' || quarter(d) || ' ' || year(d) AS quarter_label, CAST(date_trunc('quarter', d) AS DATE) AS starts, CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS ends FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def quarters(t: Tables) -> DataFrame:
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", dates.quarter_label(d).alias("quarter_label"), dates.quarter_start(d).alias("starts"), dates.quarter_end(d).alias("ends"))


@queries("I21", "SELECT l_orderkey, l_linenumber, greatest(0.0, least(1.0, coalesce(CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount * 12 END, 0.5))) AS confidence FROM lineitem")
def clamped(t: Tables) -> DataFrame:
    raw = F.coalesce(F.when(F.col("l_linenumber") != 3, F.col("l_discount") * 12), F.lit(0.5))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)).alias("confidence"))


@queries("I22 I23 O1", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'in_progress' WHEN 'P' THEN 'awaiting' ELSE 'unknown' END AS status, CASE o_orderstatus WHEN 'F' THEN 'on_track' WHEN 'O' THEN 'at_risk' WHEN 'P' THEN 'off_track' ELSE 'unknown' END AS health, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 2 WHEN 'P' THEN 3 ELSE 5 END AS severity FROM orders""")
def mapped_status(t: Tables) -> DataFrame:
    def looked_up(pairs: dict, default: object) -> F.Column:
        table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
        return F.coalesce(table[F.col("o_orderstatus")], F.lit(default))

    return t.orders.select(
        "o_orderkey", looked_up({"F": "complete", "O": "in_progress", "P": "awaiting"}, "unknown").alias("status"),
        looked_up({"F": "on_track", "O": "at_risk", "P": "off_track"}, "unknown").alias("health"), looked_up({"F": 0, "O": 2, "P": 3}, 5).alias("severity"),
    )


@queries("I24 I25", "SELECT doc_id, sha256(text) AS content_key, substr(sha256(text), 1, 16) AS short_key, 'doc-' || substr(sha1(text), 1, 10) AS stable_id FROM documents")
def content_keys(t: Tables) -> DataFrame:
    sha = F.sha2("text", 256)
    return t.documents.select("doc_id", sha.alias("content_key"), F.substring(sha, 1, 16).alias("short_key"), F.concat(F.lit("doc-"), F.substring(F.sha1("text"), 1, 10)).alias("stable_id"))


@queries("I26", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 60) * 60 + (event_id % 50) WHEN 1 THEN 3600 + (event_id % 60) * 60 + (event_id % 50) ELSE 1000000000 END AS seconds FROM events""")
def timestamps_in_seconds(t: Tables) -> DataFrame:
    m, s = F.col("event_id") % 60, F.col("event_id") % 50
    said = F.when(F.col("event_id") % 3 == 0, F.format_string("%d:%02d", m, s)).when(F.col("event_id") % 3 == 1, F.format_string("1:%02d:%02d", m, s)).otherwise("soon")
    return t.events.select("event_id", dates.clock_seconds(said).alias("seconds"))


@queries("I28", r"""SELECT item_id, regexp_replace(regexp_replace(regexp_replace(text, '\bthing of\b', 'item of', 'g'), '\bthing\b', 'item', 'g'), '\bthe\b', 'The', 'g') AS s FROM benchmark""")
def glossary_replaced(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", replace_words(F.col("text"), {"thing of": "item of", "thing": "item", "the": "The"}).alias("s"))


@queries("I31", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k FROM events""")
def json_in_free_text(t: Tables) -> DataFrame:
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here you are:\n```json\n"), "props", F.lit("\n``` done"))).otherwise("nothing {broken")
    return t.events.select("event_id", phrases.json_object_in(said, "k int")["k"].alias("k"))
