"""Scores of turns, and patterns over neighbouring turns, read from their text.

As in ``wording``, the sample texts hit few cues; tests run the queries over a table of sentences as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.text import bounded
from quillwork.plans.book import Book
from quillwork.sources.tables import Tables

queries = Book()

CUES = {
    "question": r"\?$", "asks": "^(?:can|could|would|please) ", "commits": r"\b(?:i'll|we will|i am doing)\b", "accepts": r"\b(?:agreed|agree|sounds good|fine)\b",
    "rejects": r"\b(?:no|cannot|won't)\b", "unsure": r"\b(?:maybe|not sure|unclear)\b", "proposes": r"\b(?:prefer|rather|option|approach|release)\b", "leads": "^(?:we will|let's|the team) ",
    "risky": r"\b(?:risk|problem|issue|dependency|blocked)\b", "dated": r"\b(?:by|before|tomorrow|monday|friday)\b", "navigates": r"\b(?:next|right|anything else|recap)\b", "topical": r"\b(?:budget|audit|report|client|team)\b",
    "challenges": r"\bwhat do you mean\b", "prompts": "^(?:next topic|right,|quick recap)", "counters": "^rather ",
}
VERBS = r"\b(?:send|call|ask|finish|close|release|take)\b"


def cued_turns(t: Tables) -> DataFrame:
    """Turns with their text, its lower case, a 0 or 1 for each of ``CUES``, and its counts of words,
    distinct words and verbs of action."""
    low = F.lower(F.col("said"))
    tokens = F.regexp_extract_all("low", F.lit("[a-z0-9']+"), F.lit(0))
    rows = t.conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("said")).withColumn("low", low)
    rows = rows.withColumns({name: F.col("low").rlike(bounded(p)).cast("int") for name, p in CUES.items()})
    return rows.withColumns({"n": F.size(tokens), "kinds": F.size(F.array_distinct(tokens)), "verbs": F.regexp_count("low", F.lit(bounded(VERBS)))})


_quote = lambda p: "'" + p.replace("'", "''") + "'"
#: The same rows, as two tables of a WITH clause.
TURNS = (
    "t0 AS (SELECT conv_id, turn, role, coalesce(text, '') AS said, lower(coalesce(text, '')) AS low FROM conversations), "
    f"turns AS (SELECT *, {', '.join(f'CAST(regexp_matches(low, {_quote(p)}) AS INT) AS {name}' for name, p in CUES.items())}, len(regexp_extract_all(low, '[a-z0-9'']+')) AS n, len(list_distinct(regexp_extract_all(low, '[a-z0-9'']+'))) AS kinds, len(regexp_extract_all(low, {_quote(VERBS)})) AS verbs FROM t0)"
)

#: The coefficients. Scores of a turn, each an expression over the cues and the scores before it.
SCORES = (
    ("request", "0.4 * question + 0.45 * asks"), ("commitment", "0.45 * commits"), ("acceptance", "0.42 * accepts"), ("rejection", "0.62 * rejects"), ("uncertainty", "0.6 * unsure"),
    ("proposal", "0.4 * proposes + 0.2 * leads"), ("risk", "0.55 * risky"), ("deadline", "0.75 * dated"), ("owner", "CASE WHEN role = 'user' THEN 0.45 ELSE 0.0 END"),
    ("specificity", "least(0.95, greatest(0.0, (n - 2) / 10.0))"), ("navigation", "0.6 * navigates + 0.2 * prompts"),
    ("low_content", "CASE WHEN n <= 2 THEN 0.8 WHEN accepts = 1 AND n <= 4 THEN 0.65 ELSE 0.0 END"), ("topic_continuity", "0.0 * n"),
    ("decision", "greatest(0.0, least(0.95, proposal + acceptance * 0.35 + specificity * 0.25 - navigation * 0.6 - uncertainty * 0.5))"),
    ("action", "greatest(0.0, least(0.95, least(0.9, 0.18 * verbs + commitment + request * 0.35) - navigation * 0.65 - low_content * 0.25))"),
    ("discussion", "greatest(0.0, least(0.95, least(0.9, 0.14 * kinds + 0.25 * topical) - navigation * 0.7 - low_content * 0.55))"),
)
_NAMES = [name for name, _ in SCORES]
_SCORED = TURNS
_at = "turns"
for _i, (_name, _formula) in enumerate(SCORES):
    _SCORED += f", s{_i} AS (SELECT *, CAST({_formula} AS DOUBLE) AS {_name} FROM {_at})"
    _at = f"s{_i}"
_round = lambda x: f"round({x} + 1e-9, 2)"


def _scored(t: Tables) -> DataFrame:
    rows = cued_turns(t)
    for name, formula in SCORES:
        rows = rows.withColumn(name, F.expr(formula).cast("double"))
    return rows


@queries("V8", f"WITH {_SCORED} SELECT conv_id, turn, {', '.join(f'{_round(n)} AS {n}' for n in _NAMES)} FROM {_at}")
def sentence_scores(t: Tables) -> DataFrame:
    """Sixteen scores of each turn's sentence, of two decimals."""
    return _scored(t).select("conv_id", "turn", *[F.round(F.col(n) + 1e-9, 2).alias(n) for n in _NAMES])


_WINDOW = {name: f"max({name})" for name in ("request", "commitment", "acceptance", "rejection", "uncertainty", "proposal", "risk", "deadline", "owner")} | {n: f"avg({n})" for n in ("specificity", "navigation", "low_content", "discussion")}
_BOTH = {
    "w_decision": "greatest(proposal, 0.35 * accepts) + acceptance * 0.6 - rejection * 0.85 - uncertainty * 0.8 - navigation * 0.7",
    "w_action": "request * 0.65 + commitment * 0.8 + acceptance * 0.35 + deadline * 0.2 + owner * 0.15 - rejection * 0.9 - uncertainty * 0.45 - navigation * 0.7",
    "w_discussion": "discussion + words / 20.0 - navigation * 0.85 - low_content * 0.7",
}


@queries("F6", f"""WITH {_SCORED}, w AS (SELECT conv_id, turn, 2 AS width, {', '.join(f'{f} OVER a AS {n}' for n, f in _WINDOW.items())}, sum(kinds) OVER a AS words, max(accepts) OVER a AS accepts, count(*) OVER a AS held, max(prompts) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS crossed FROM {_at} WINDOW a AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)
UNION ALL SELECT conv_id, turn, 3, {', '.join(f'{f} OVER a' for f in _WINDOW.values())}, sum(kinds) OVER a, max(accepts) OVER a, count(*) OVER a, max(prompts) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) FROM {_at} WINDOW a AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT conv_id, turn, width, {', '.join(f'{_round(f)} AS {n}' for n, f in _BOTH.items())} FROM w WHERE held = width AND crossed = 0""")
def sentence_windows(t: Tables) -> DataFrame:
    """Windows of two and three turns with the scores of the whole; none reaches into a new topic."""
    rows, found = _scored(t), None
    by = Window.partitionBy("conv_id").orderBy("turn")
    for width in (2, 3):
        over = by.rowsBetween(0, width - 1)
        scores = [F.expr(f).over(over).alias(n) for n, f in _WINDOW.items()]
        one = rows.select("conv_id", "turn", F.lit(width).alias("width"), *scores, F.sum("kinds").over(over).alias("words"), F.max("accepts").over(over).alias("accepts"), F.count(F.lit(1)).over(over).alias("held"), F.max("prompts").over(by.rowsBetween(1, width - 1)).alias("crossed"))
        found = one if found is None else found.unionByName(one)
    found = found.filter("held = width and crossed = 0")
    return found.select("conv_id", "turn", "width", *[F.round(F.expr(f) + 1e-9, 2).alias(n) for n, f in _BOTH.items()])


#: Patterns of a turn (cues of the turn, the next, the one after); a pattern needs all of its cues.
PATTERNS = (
    ("vague_challenged", ("unsure",), ("challenges",), ()), ("request_rejection", ("asks",), ("rejects",), ()), ("request_commitment", ("asks",), ("commits",), ()), ("request_acceptance", ("asks",), ("accepts",), ()),
    ("problem_commitment", ("risky",), ("commits",), ()), ("proposal_accepted", ("proposes",), ("accepts",), ()), ("proposal_countered_accepted", ("proposes",), ("counters",), ("accepts",)), ("question_answered", ("question",), ("commits",), ("accepts",)),
)


@queries("F7", f"""WITH {TURNS}, l AS (SELECT *, {', '.join(f'lead({c}) OVER w AS {c}_1, lead({c}, 2) OVER w AS {c}_2' for c in CUES)} FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) """
    + " UNION ALL ".join(f"SELECT conv_id, turn, '{name}' AS pattern FROM l WHERE {' AND '.join(f'{c}{s} = 1' for cues, s in ((a, ''), (b, '_1'), (c3, '_2')) for c in cues)}" for name, a, b, c3 in PATTERNS))
def turn_window_patterns(t: Tables) -> DataFrame:
    """Every pattern that starts at a turn."""
    by = Window.partitionBy("conv_id").orderBy("turn")

    def hit(cues: tuple[str, ...], ahead: int) -> Column:
        all_of = F.lit(True)
        for c in cues:
            all_of = all_of & (F.coalesce(F.lead(c, ahead).over(by) if ahead else F.col(c), F.lit(0)) == 1)
        return all_of

    found = F.array(*[F.when(hit(a, 0) & hit(b, 1) & hit(c, 2), F.lit(name)) for name, a, b, c in PATTERNS])
    rows = cued_turns(t).select("conv_id", "turn", found.alias("found"))
    return rows.select("conv_id", "turn", F.explode(F.filter("found", lambda x: x.isNotNull())).alias("pattern"))


_ASSIGNS, _CONFIRMS, _SELF, _CLOSES, _MARKER = r"^[a-z]+, you are\b", r"^(?:yes|yeah|agreed),? ", r"\bi am doing\b", r"\bthanks everyone\b|\bsee you\b", r"\b(?:quick|final) recap\b"


@queries("N14", rf"""WITH {TURNS}, m AS (SELECT conv_id, min(turn) AS marker FROM turns WHERE regexp_matches(low, '{_MARKER}') GROUP BY 1), e AS (SELECT m.conv_id, any_value(marker) AS marker, coalesce(min(t.turn) FILTER (WHERE t.turn > marker AND regexp_matches(low, '{_CLOSES}')) - 1, least(max(t.turn), any_value(marker) + 24)) AS stop FROM m JOIN turns t ON t.conv_id = m.conv_id AND t.turn <= marker + 24 GROUP BY m.conv_id),
c AS (SELECT e.conv_id, marker, stop, count(*) FILTER (WHERE regexp_matches(low, '{_ASSIGNS}')) AS assigned, count(*) FILTER (WHERE regexp_matches(low, '{_CONFIRMS}')) AS confirmed, count(*) FILTER (WHERE regexp_matches(low, '{_SELF}')) AS own FROM e JOIN turns t ON t.conv_id = e.conv_id AND t.turn BETWEEN marker AND stop GROUP BY 1, 2, 3)
SELECT d.conv_id, marker, stop, round(CASE WHEN stop IS NULL THEN 1.0 ELSE least(0.99, 0.45 + 0.13 * assigned + 0.04 * confirmed + 0.08 * own) END, 4) AS confidence, CASE WHEN assigned >= 2 AND least(0.99, 0.45 + 0.13 * assigned + 0.04 * confirmed + 0.08 * own) >= 0.72 THEN 'distributed_recap' ELSE 'standard' END AS mode FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN c USING (conv_id)""")
def recap_topologies(t: Tables) -> DataFrame:
    """Whether a conversation ends in a recap: from its first marker to a closing, 24 turns at most."""
    turns = cued_turns(t).select("conv_id", "turn", "low")
    first = turns.groupBy("conv_id").agg(F.min(F.when(F.col("low").rlike(bounded(_MARKER)), F.col("turn"))).alias("marker"))
    near = turns.join(first, "conv_id").filter(F.col("turn").between(F.col("marker"), F.col("marker") + 24))
    stops = near.groupBy("conv_id").agg(F.coalesce(F.min(F.when((F.col("turn") > F.col("marker")) & F.col("low").rlike(bounded(_CLOSES)), F.col("turn"))) - 1, F.max("turn")).alias("stop"))
    n = lambda p: F.count(F.when(F.col("low").rlike(bounded(p)), True))
    counts = near.join(stops, "conv_id").filter("turn <= stop").groupBy("conv_id", "stop").agg(n(_ASSIGNS).alias("assigned"), n(_CONFIRMS).alias("confirmed"), n(_SELF).alias("own"))
    score = F.least(F.lit(0.99), 0.45 + 0.13 * F.col("assigned") + 0.04 * F.col("confirmed") + 0.08 * F.col("own"))
    mode = F.when((F.col("assigned") >= 2) & (score >= 0.72), "distributed_recap").otherwise("standard")
    out = first.join(counts, "conv_id", "left")
    return out.select("conv_id", "marker", "stop", F.round(F.coalesce(F.when(F.col("stop").isNotNull(), score), F.lit(1.0)), 4).alias("confidence"), mode.alias("mode"))


@queries("N9", f"""WITH {TURNS}, z AS (SELECT conv_id, count(*) AS all_turns FROM turns GROUP BY 1), f AS (SELECT conv_id, role, count(*) AS n, count(DISTINCT said) AS speakers, max(turn) - min(turn) AS span, sum(greatest(risky, commits)) AS weighty, max(topical) AS titled, min(turn) AS opens, max(turn) AS ends, max(proposes) AS purpose FROM turns GROUP BY 1, 2)
SELECT conv_id, role, round(least(n, 8) * 0.55 + least(speakers, 4) * 0.35 + least(span / greatest(all_turns, 1), 0.5) * 1.4 + weighty * 0.32 + titled * 0.45 + CASE WHEN opens <= greatest(8, round(all_turns * 0.12)) THEN 0.45 ELSE 0 END + CASE WHEN ends >= round(all_turns * 0.82) THEN 0.25 ELSE 0 END + purpose * 0.4 + 1e-9, 3) AS salience FROM f JOIN z USING (conv_id)""")
def stream_salience(t: Tables) -> DataFrame:
    """Weight of each role's turns: density, breadth, continuity, consequence, title, opening and closing, purpose."""
    turns = cued_turns(t)
    size = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("all_turns"))
    f = turns.groupBy("conv_id", "role").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("said").alias("speakers"), (F.max("turn") - F.min("turn")).alias("span"), F.sum(F.greatest("risky", "commits")).alias("weighty"),
        F.max("topical").alias("titled"), F.min("turn").alias("opens"), F.max("turn").alias("ends"), F.max("proposes").alias("purpose"),
    )
    c, total = F.col, F.col("all_turns")
    score = F.least(c("n"), F.lit(8)) * 0.55 + F.least(c("speakers"), F.lit(4)) * 0.35 + F.least(c("span") / F.greatest(total, F.lit(1)), F.lit(0.5)) * 1.4 + c("weighty") * 0.32 + c("titled") * 0.45
    score = score + F.when(c("opens") <= F.greatest(F.lit(8.0), F.round(total * 0.12)), 0.45).otherwise(0.0) + F.when(c("ends") >= F.round(total * 0.82), 0.25).otherwise(0.0) + c("purpose") * 0.4
    return f.join(size, "conv_id").select("conv_id", "role", F.round(score + 1e-9, 3).alias("salience"))


@queries("N10", f"""WITH {TURNS}, a AS (SELECT conv_id, said, count(DISTINCT turn % 3) AS support, max(commits) AS committed FROM turns WHERE verbs > 0 OR commits = 1 GROUP BY 1, 2) SELECT conv_id, said, support, CASE WHEN support * 2 >= 4 THEN 1 ELSE 2 END AS tier FROM a WHERE support * 2 >= 4 OR committed = 1""")
def tiers_of_actions(t: Tables) -> DataFrame:
    """Actions that most of three samples agree on are of tier 1, those of a direct commitment of tier 2; others go."""
    samples = 3
    a = cued_turns(t).filter("verbs > 0 or commits = 1").groupBy("conv_id", "said").agg(F.countDistinct(F.col("turn") % samples).alias("support"), F.max("commits").alias("committed"))
    most = F.col("support") * 2 >= samples + 1
    return a.filter(most | (F.col("committed") == 1)).select("conv_id", "said", "support", F.when(most, 1).otherwise(2).alias("tier"))


@queries("E18", f"""WITH {TURNS}, b AS (SELECT conv_id, turn, said, CASE WHEN risky = 1 THEN 'risk' WHEN commits = 1 THEN 'action' WHEN accepts = 1 THEN 'decision' ELSE 'discussion' END AS bucket FROM turns) SELECT conv_id, bucket, count(*) AS n, string_agg(turn || ':' || said, '|' ORDER BY turn) AS entries FROM b GROUP BY 1, 2""")
def bucket_scorecard(t: Tables) -> DataFrame:
    """Count and entries of each bucket of a conversation, in order; a conversation's turns are bounded."""
    bucket = F.when(F.col("risky") == 1, "risk").when(F.col("commits") == 1, "action").when(F.col("accepts") == 1, "decision").otherwise("discussion")
    one = F.struct("turn", F.concat_ws(":", "turn", "said").alias("entry"))
    entries = F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["entry"]), "|")
    return cued_turns(t).withColumn("bucket", bucket).groupBy("conv_id", "bucket").agg(F.count(F.lit(1)).alias("n"), entries.alias("entries"))


@queries("J7", rf"""WITH l AS (SELECT conv_id, turn, line_at - 1 AS line_no, trim(lines[line_at]) AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS lines FROM conversations), LATERAL (SELECT unnest(generate_series(1, len(lines))) AS line_at)), u AS (SELECT conv_id, turn, line_no, unit_at - 1 AS unit_no, units[unit_at] AS unit FROM (SELECT *, list_filter(list_transform(string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS units FROM l), LATERAL (SELECT unnest(generate_series(1, len(units))) AS unit_at)),
w AS (SELECT *, len(string_split_regex(unit, '\s+')) AS n, coalesce(lag(unit) OVER (PARTITION BY conv_id ORDER BY turn, line_no, unit_no), '') AS before FROM u) SELECT conv_id, turn || '.' || line_no || '.' || unit_no AS unit_id, unit, n < 3 AS protected FROM w WHERE n >= 3 OR before LIKE '%?'""")
def identified_units(t: Tables) -> DataFrame:
    """Sentences with ids of turn, line and unit. Units of less than three words go, but for the answer to a question."""
    lines = t.conversations.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    units = F.filter(F.transform(F.split(F.regexp_replace(F.trim("line"), r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda x: F.trim(x)), lambda x: x != "")
    u = lines.select("conv_id", "turn", "line_no", F.posexplode(units).alias("unit_no", "unit"))
    before = F.lag("unit").over(Window.partitionBy("conv_id").orderBy("turn", "line_no", "unit_no"))
    u = u.withColumns({"n": F.size(F.split("unit", r"\s+")), "before": F.coalesce(before, F.lit(""))})
    kept = u.filter((F.col("n") >= 3) | F.endswith("before", F.lit("?")))
    return kept.select("conv_id", F.concat_ws(".", "turn", "line_no", "unit_no").alias("unit_id"), "unit", (F.col("n") < 3).alias("protected"))


@queries("J11", """WITH f AS (SELECT conv_id, 'fixed' AS how, CAST(floor(turn / 3) AS BIGINT) AS chunk, turn, text FROM conversations UNION ALL SELECT conv_id, 'shifted', CAST(floor((turn + 1.5) / 3) AS BIGINT), turn, text FROM conversations) SELECT conv_id, how, chunk, min(turn) AS first_turn, max(turn) AS last_turn, sha256(string_agg(text, chr(10) ORDER BY turn)) AS said FROM f GROUP BY 1, 2, 3""")
def chunked_two_ways(t: Tables) -> DataFrame:
    """The turns of a conversation in chunks of three, and in chunks that begin at the midpoints of those."""
    one = lambda how, shift: t.conversations.select("conv_id", F.lit(how).alias("how"), F.floor((F.col("turn") + shift) / 3).alias("chunk"), "turn", "text")
    both = one("fixed", 0).union(one("shifted", 1.5))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return both.groupBy("conv_id", "how", "chunk").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sha2(text, 256).alias("said"))


@queries("J15", r"""WITH x AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations), r AS (SELECT conv_id, line, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^\[.*\]$') THEN 'event' WHEN regexp_matches(line, '^[A-Z ]+ \d{1,2}:\d{2}$') THEN 'timestamp' WHEN regexp_matches(line, '^(Meeting Title|Attendees|Agenda)') THEN 'header' ELSE 'kept' END AS reason FROM x) SELECT conv_id, reason, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM r GROUP BY 1, 2""")
def denoise_reasons(t: Tables) -> DataFrame:
    """Lines of a transcript by why they go: blank, event, timestamp or header; others are kept."""
    line = t.conversations.select("conv_id", F.explode(F.split("text", "\n")).alias("line"))
    c = F.col("line")
    reason = F.when(F.trim(c) == "", "blank").when(c.rlike(r"^\[.*\]$"), "event").when(c.rlike(r"^[A-Z ]+ \d{1,2}:\d{2}$"), "timestamp").when(c.rlike("^(Meeting Title|Attendees|Agenda)"), "header").otherwise("kept")
    return line.groupBy("conv_id", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


SORTS = {"newest": [("ts", False), ("event_id", True)], "oldest": [("ts", True), ("event_id", True)], "title_asc": [("event_type", True), ("event_id", True)], "title_desc": [("event_type", False), ("event_id", True)]}


def page(rows: DataFrame, sort: str, offset: int, size: int) -> DataFrame:
    """A page of rows in one of the orders of ``SORTS``; another order is refused."""
    if sort not in SORTS:
        raise ValueError(f"no such order: {sort}")
    return rows.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in SORTS[sort]]).offset(max(0, offset)).limit(min(100, max(1, size)))


@queries("G4", " UNION ALL ".join(f"(SELECT '{s}' AS sort, event_id FROM events ORDER BY {', '.join(c + (' ASC' if up else ' DESC') for c, up in keys)} LIMIT 12 OFFSET 24)" for s, keys in SORTS.items()))
def sorted_pages(t: Tables) -> DataFrame:
    """The third page of twelve in each of the permitted orders."""
    pages = [page(t.events.select("event_id", "ts", "event_type"), s, 24, 12).select(F.lit(s).alias("sort"), "event_id") for s in SORTS]
    return pages[0].union(pages[1]).union(pages[2]).union(pages[3])


#: Phrases that are often misheard, in the order in which they are put right; fixed values.
MISHEARD = (("quick recap", "short recap"), ("short recap of the actions", "recap of actions"), ("the board", "the Board"), ("other approach", "alternative"))


@queries("I30", f"""WITH {TURNS} SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(said, '(?i)\\b{MISHEARD[0][0]}\\b', '{MISHEARD[0][1]}', 'g'), '(?i)\\b{MISHEARD[1][0]}\\b', '{MISHEARD[1][1]}', 'g'), '(?i)\\b{MISHEARD[2][0]}\\b', '{MISHEARD[2][1]}', 'g'), '(?i)\\b{MISHEARD[3][0]}\\b', '{MISHEARD[3][1]}', 'g') AS said FROM turns""")
def corrected_phrases(t: Tables) -> DataFrame:
    """Misheard phrases put right one after another, so a later rule sees what an earlier one wrote."""
    said = F.col("said")
    for wrong, right in MISHEARD:
        said = F.regexp_replace(said, bounded(rf"(?i)\b{wrong}\b"), right)
    return cued_turns(t).select("conv_id", "turn", said.alias("said"))


MILESTONES = ("budget", "audit", "release", "report", "approach", "option")


@queries("O9", f"""WITH {TURNS}, w AS (SELECT *, coalesce(lag(low) OVER x, '') || ' ' || low || ' ' || coalesce(lead(low) OVER x, '') AS around FROM turns WINDOW x AS (PARTITION BY conv_id ORDER BY turn)), m AS (SELECT conv_id, turn, k, CASE WHEN regexp_matches(around, '\\b(?:blocked|problem|risk)\\b') THEN 'blocked' WHEN regexp_matches(around, '\\b(?:agreed|fine|close)\\b') THEN 'complete' ELSE 'in_progress' END AS status FROM w, (SELECT unnest({list(MILESTONES)}) AS k) WHERE regexp_matches(low, '\\b' || k || '\\b'))
SELECT conv_id, k AS milestone, min(turn) AS first_turn, arg_min(status, turn) AS status, count(*) AS mentions FROM m GROUP BY 1, 2""")
def milestones_mentioned(t: Tables) -> DataFrame:
    """Milestones that a conversation names, with the status that the sentence and its neighbours tell of at the first mention."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    around = F.concat_ws(" ", F.coalesce(F.lag("low").over(w), F.lit("")), "low", F.coalesce(F.lead("low").over(w), F.lit("")))
    rows = cued_turns(t).select("conv_id", "turn", "low", around.alias("around"))
    status = F.when(F.col("around").rlike(bounded(r"\b(?:blocked|problem|risk)\b")), "blocked").when(F.col("around").rlike(bounded(r"\b(?:agreed|fine|close)\b")), "complete").otherwise("in_progress")
    named = F.filter(F.array(*[F.when(F.col("low").rlike(bounded(rf"\b{k}\b")), F.lit(k)) for k in MILESTONES]), lambda k: k.isNotNull())
    m = rows.select("conv_id", "turn", status.alias("status"), F.explode(named).alias("milestone"))
    return m.groupBy("conv_id", "milestone").agg(F.min("turn").alias("first_turn"), F.min_by("status", "turn").alias("status"), F.count(F.lit(1)).alias("mentions"))
