"""What turns say: timing, deadlines, dates, usefulness, trend and people, read from their text.

The sample texts are invented words that hit few of these rules; tests run the queries and their SQL over a table
of sentences as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions import wording
from quillwork.functions.dates import DAYS
from quillwork.plans.book import Book
from quillwork.plans.classifying import status_of
from quillwork.sources.tables import Tables

queries = Book()

_SQL = f"""WITH s AS (SELECT conv_id, turn, text AS said, lower(coalesce(text, '')) AS low, CAST(DATE '2024-01-01' + CAST(conv_id % 365 AS INT) AS DATE) AS base FROM conversations),
k AS (SELECT *, regexp_extract_all(low, '{wording.TOKEN.replace("'", "''")}') AS words FROM s), w AS (SELECT *, {wording.reading_sql('words')} AS r FROM k)"""


def _said(t: Tables) -> DataFrame:
    """Turns with their text and the day on which they were said."""
    return t.conversations.select("conv_id", "turn", F.col("text").alias("said"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 365).cast("int")).alias("base"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _timing(column: str) -> str:
    hit = lambda p: f"regexp_matches({column}, '{p}')"
    cases = " ".join(f"WHEN {hit(p)}{f' AND NOT {hit(no)}' if no else ''} THEN '{kind}'" for kind, p, no in wording.TIMING)
    return f"CASE WHEN {column} = '' THEN 'empty' {cases} ELSE 'specific' END"


def _at(phrase: str, part: int = 1) -> str:
    return f"length(regexp_extract(r, '^(.*?)({phrase})', {part}))"


@queries("I15", f"{_SQL} SELECT conv_id, turn, {_timing('r')} AS kind FROM w")
def timing_wordings(t: Tables) -> DataFrame:
    """The kind of timing that each turn's wording is."""
    return _said(t).select("conv_id", "turn", wording.timing_wording(F.col("said")).alias("kind"))


_DAYS = "[" + ", ".join(f"'{d}'" for d in DAYS) + "]"
_NUMBER = "coalesce(CASE " + " ".join(f"WHEN n = '{w}' THEN {i}" for w, i in wording.NUMBERS.items()) + " END, TRY_CAST(n AS INT), 1)"


@queries("I16", f"""{_SQL}, o AS (SELECT *, {_timing('r')} AS kind, (list_position({_DAYS}, words[{_at('W')} + 1]) - 1 - (isodow(base) - 1) + 7) % 7 AS off, words[{_at('k[nh][DK]')} + 2] AS n FROM w)
SELECT conv_id, turn, CAST(CASE WHEN kind = 'ambiguous_weekday' THEN CASE WHEN off = 0 THEN base + 7 END WHEN kind <> 'specific' THEN NULL WHEN contains(r, 'I') THEN TRY_CAST(words[{_at('I')} + 1] AS DATE)
  WHEN regexp_matches(r, 't|{wording.CLOSE}') THEN base WHEN contains(r, 'T') THEN base + 1 WHEN contains(r, 'W') THEN CASE WHEN off <> 0 OR regexp_matches(r, '[xp]') THEN base + CAST(off AS INT) END
  WHEN regexp_matches(r, 'k[nh][DK]') THEN base + CAST({_NUMBER} * CASE WHEN regexp_matches(r, 'k[nh]K') THEN 7 ELSE 1 END AS INT) END AS VARCHAR) AS day FROM o""")
def resolved_days(t: Tables) -> DataFrame:
    """The date that each turn's wording means on its day."""
    return _said(t).select("conv_id", "turn", wording.resolved_day(F.col("said"), F.col("base")).cast("string").alias("day"))


@queries("I20", f"""{_SQL}, p AS (SELECT *, {_at(wording.DEADLINE)} AS before, {_at(wording.DEADLINE, 2)} AS n FROM w)
SELECT conv_id, turn, CASE WHEN n = 0 OR regexp_matches(r, '{wording.PAST}') THEN 'Not stated' ELSE regexp_replace(array_to_string(words[before + 1:before + n], ' '), '^(?:by|on) ', '') END AS deadline FROM p""")
def deadline_wordings(t: Tables) -> DataFrame:
    """The deadline that each turn names."""
    return _said(t).select("conv_id", "turn", wording.deadline_wording(F.col("said")).alias("deadline"))


def _among(own: frozenset[str]) -> str:
    return f"list_has_any(u, [{', '.join(repr(w) for w in sorted(own))}])"


_WORTH = [
    ("remove", "reply", f"len(u) = 1 AND {_among(wording.ACKNOWLEDGING)}"),
    ("remove", "mark", r"regexp_matches(low, '\[[a-z ]+\]')"),
    ("remove", "line", _among(wording.TECHNICAL)),
    ("remove", "few words", f"len(u) <= {wording.FEW_WORDS}"),
    *(("retain", name, f"len(u) >= {least} AND ({_among(own)}{' OR regexp_matches(low, ' + repr('[0-9]') + ')' if name == 'substance' else ''})") for name, least, own in wording.WEIGHTY),
]


@queries("N2", rf"""{_SQL}, v AS (SELECT *, regexp_extract_all(low, '[a-z0-9'']+') AS u FROM w) SELECT conv_id, turn, CASE {' '.join(f"WHEN {hit} THEN '{label}'" for label, _, hit in _WORTH)} ELSE 'uncertain' END AS label,
  CASE {' '.join(f"WHEN {hit} THEN '{reason}'" for _, reason, hit in _WORTH)} ELSE 'open' END AS reason FROM v""")
def usefulness_labels(t: Tables) -> DataFrame:
    """Whether each turn is worth keeping, and why."""
    label, reason = wording.usefulness(F.col("said"))
    return _said(t).select("conv_id", "turn", label.alias("label"), reason.alias("reason"))


@queries("N6", rf"""{_SQL}, c AS (SELECT *, low AS s FROM w), st AS (SELECT *, CASE WHEN regexp_matches(s, '\bnot started\b') THEN 'not_started' WHEN regexp_matches(s, '\b(blocked|stuck)\b') THEN 'blocked' WHEN regexp_matches(s, '\b(done|complete|finished)\b') THEN 'complete' WHEN regexp_matches(s, '\b(waiting|awaiting)\b') THEN 'awaiting' ELSE 'in_progress' END AS status FROM c)
SELECT conv_id, turn, status, CASE WHEN regexp_matches(s, '{wording.TREND_UP}') THEN 'improving' WHEN regexp_matches(s, '{wording.TREND_DOWN}') THEN 'deteriorating' WHEN status = 'complete' THEN 'resolved' WHEN status IN ('blocked', 'awaiting') THEN 'deteriorating' WHEN status = 'in_progress' THEN 'stable' ELSE 'unknown' END AS trend FROM st""")
def trends_of_turns(t: Tables) -> DataFrame:
    status = status_of(F.col("said"))
    return _said(t).select("conv_id", "turn", status.alias("status"), wording.trend(F.col("said"), status).alias("trend"))


@queries("I18", rf"""{_SQL}, p AS (SELECT conv_id, turn, regexp_extract(low, '\b({wording.DAY})[,:(]? ?(\d{{4}}-\d{{2}}-\d{{2}})', 1) AS b_day, TRY_CAST(nullif(regexp_extract(low, '\b({wording.DAY})[,:(]? ?(\d{{4}}-\d{{2}}-\d{{2}})', 2), '') AS DATE) AS b,
regexp_extract(low, '(\d{{4}}-\d{{2}}-\d{{2}})(?:, ?| ?\()({wording.DAY})\b', 2) AS a_day, TRY_CAST(nullif(regexp_extract(low, '(\d{{4}}-\d{{2}}-\d{{2}})(?:, ?| ?\()({wording.DAY})\b', 1), '') AS DATE) AS a,
regexp_extract(low, '\b(first|second|third|fourth|fifth|last) ({wording.DAY}) of the month, (\d{{4}}-\d{{2}}-\d{{2}})', 1) AS nth, regexp_extract(low, '\b(first|second|third|fourth|fifth|last) ({wording.DAY}) of the month, (\d{{4}}-\d{{2}}-\d{{2}})', 2) AS n_day, TRY_CAST(nullif(regexp_extract(low, '\b(first|second|third|fourth|fifth|last) ({wording.DAY}) of the month, (\d{{4}}-\d{{2}}-\d{{2}})', 3), '') AS DATE) AS n FROM w)
SELECT conv_id, turn, issue FROM (SELECT conv_id, turn, CASE WHEN n IS NOT NULL THEN CASE WHEN lower(dayname(n)) <> n_day THEN 'weekday' WHEN NOT (CASE WHEN nth = 'last' THEN month(n + 7) <> month(n) ELSE (day(n) - 1) // 7 + 1 = list_position(['first', 'second', 'third', 'fourth', 'fifth'], nth) END) THEN 'occurrence' END
WHEN b IS NOT NULL THEN CASE WHEN lower(dayname(b)) <> b_day THEN 'weekday' END WHEN a IS NOT NULL THEN CASE WHEN lower(dayname(a)) <> a_day THEN 'weekday' END END AS issue FROM p) WHERE issue IS NOT NULL""")
def weekday_issues(t: Tables) -> DataFrame:
    found = _said(t).select("conv_id", "turn", wording.weekday_issue(F.col("said")).alias("issue"))
    return found.filter("issue is not null")


#: Words before and behind which a person's name stands; capitalised words that are no one's.
LEADING = "with to for from ask tell by".split()
FOLLOWING = "will is has can should to".split()
NO_NAMES = [*DAYS, *wording.LETTERS["M"].split(), "the", "they", "we", "he", "she", "this", "that"]


def _names(words: Column) -> Column:
    """Capitalised words with a leading word before or a following word behind them."""
    others = lambda w, own: F.coalesce(F.lower(w).isin(own), F.lit(False))
    at = lambda w, i: others(F.when(i > 0, F.get(words, i - 1)), LEADING) | others(F.get(words, i + 1), FOLLOWING)
    placed = F.transform(words, lambda w, i: F.when(w.rlike("^[A-Z][a-z]{2,15}$") & at(w, i) & ~others(w, NO_NAMES), w))
    return F.filter(placed, lambda w: w.isNotNull())


_LIST = lambda own: ", ".join(repr(w) for w in own)


@queries("V13", f"""WITH t AS (SELECT conv_id, regexp_extract_all(text, '[A-Za-z'']+') AS w FROM conversations), n AS (SELECT conv_id, unnest(list_transform(w, lambda x, i: CASE WHEN regexp_matches(x, '^[A-Z][a-z]{{2,15}}$')
  AND (coalesce(lower(w[i - 1]) IN ({_LIST(LEADING)}), false) AND i > 1 OR coalesce(lower(w[i + 1]) IN ({_LIST(FOLLOWING)}), false)) AND lower(x) NOT IN ({_LIST(NO_NAMES)}) THEN x END)) AS name FROM t)
SELECT conv_id, name, count(*) AS n FROM n WHERE name IS NOT NULL GROUP BY conv_id, name HAVING count(*) >= 2""")
def people_mentioned(t: Tables) -> DataFrame:
    """Capitalised words where a person's name stands, twice at least in a conversation, who needn't have spoken."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z']+"), F.lit(0))
    names = t.conversations.select("conv_id", words.alias("words")).select("conv_id", F.explode(_names(F.col("words"))).alias("name"))
    return names.groupBy("conv_id", "name").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
