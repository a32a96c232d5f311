"""What a sentence says of time, and what it is worth.

A sentence is read once, into tokens, and each token into a letter for what it may mean: ``W`` a weekday, ``n`` a
number, ``X`` a word like *next*. The letters of a sentence are a short string, its reading; phrases of time are a
small grammar over readings, and the kind of timing, the day that is meant and the deadline are all told from that
one reading. A letter stands for one token, so a place in a reading is a place among the tokens.

Everything is an expression of Spark's; ``reading_sql`` says the same for other SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillwork.functions.dates import DAYS

DAY = "(?:" + "|".join(DAYS) + ")"
TOKEN = r"\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{2,4}|\d{1,2}:\d{2}|\d+(?:st|nd|rd|th)|\d+|[a-z]+(?:'[a-z]+)?|[.,;!?]"
#: Tokens that aren't words, by their first fitting form.
FORMS = (("I", r"^\d{4}-"), ("A", r"^\d+[/.]\d"), ("H", "^\\d+:"), ("o", r"^\d+[a-z]"), ("n", r"^\d"), (".", "^[.,;!?]"))
NUMBERS = {w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split(), 1)}
_MONTHS = "january february march april may june july august september october november december"
#: What words may mean; any other word is "_".
LETTERS = {
    "W": " ".join(DAYS),
    "w": " ".join(f"{d}s" for d in DAYS),
    "M": _MONTHS + " " + " ".join(m[:3] for m in _MONTHS.split() if m != "may") + " sept",
    "D": "day days",
    "K": "week weeks",
    "U": "hour hours weekend weekends month months quarter quarters sprint sprints",
    "Y": "year years",
    "n": " ".join(NUMBERS),
    "o": "first second third fourth fifth",
    "h": "the of a an on at",
    "t": "today tonight",
    "T": "tomorrow",
    "y": "yesterday",
    "p": "morning lunch noon midday afternoon evening",
    "x": "this",
    "X": "next coming",
    "L": "last previous previously",
    "v": "every each",
    "f": "daily weekly fortnightly monthly quarterly yearly regularly",
    "b": "by",
    "B": "before prior ahead",
    "a": "after once following when unless if pending subject depends",
    "u": "until",
    "j": "and or to through",
    "r": "between from",
    "k": "in within",
    "d": "for lasting takes take over",
    "g": "ago",
    "e": "end",
    "c": "close",
    "s": "start beginning",
    "C": "business play",
    "z": "working",
    "N": "not never no except instead rather",
    "Q": "earlier sooner earliest",
    "q": "about around roughly maybe probably early mid late",
    "E": "call meeting review session workshop audit submission release launch approval",
    "V": "was were met reviewed discussed happened done",
}

#: Phrases over readings.
DATE = "(?:I|[no]h?M|Mh?[no])"
CLOSE = "[ec]h*[DC]"
_SPAN = "[DKUY]"
#: Kinds of timing with a reading that must hit and one that mustn't. The kinds and the order in which they are tried.
TIMING = (
    ("ambiguous_numeric_date", "A", None),
    ("recurrence", f"v[XLo_]?(?:W|p|{_SPAN})|w|f", None),
    ("past_period", "LY", DATE),
    ("bound", "[Nh]Q|N[Bu]", None),
    ("negated", "N", None),
    ("past_period", "LW", None),
    ("range", "[Wt][ju][TW]", None),
    ("specific", CLOSE, None),
    ("ordinal_period", f"[oL]z?{_SPAN}", DATE),
    ("range", "r.*[ju]|[no]M?[ju][no]", None),
    ("bound", "Bh*[WMo]", None),
    ("dependency", "[aBu]", None),
    ("duration", f"d[nh]{_SPAN}|{_SPAN}g", None),
    ("business_interval", "[zC]D", None),
    ("specific", "W", "XW"),
    ("specific", DATE, None),
    ("approximate", "q", None),
    ("period", f"[xX]{_SPAN}|e", None),
    ("ambiguous_weekday", "XW", None),
    ("specific", "[tTk]|xp", None),
)
#: A telling of something past has no deadline.
PAST = f"V.*(?:y|L{_SPAN}|{_SPAN}g)|L{_SPAN}.*V"
#: A deadline: a day, an edge of a period, a part of a day, a number of days, an event, or what has to happen first.
DEADLINE = "|".join(
    (
        f"b?h*{DATE}n?",
        "[bB]?h*[ecs]h*C?h*[xX]?h*[WtTDKUYC]",
        "h*[Xo]z?[DKU]a[^.]*",
        "k[nh][zC]?[DKU](?:h+_)?",
        "[bh]?H_?h*[tTW]?",
        "[bB]?h*x?p",
        "[bB]?h*[tTW]",
        "[bB]?h*[xX][KUY]",
        "[bB]h*X?h*E",
        "[Ba][^.]{1,12}",
    )
)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def reading(tokens: Column) -> Column:
    """A letter for each token."""
    letters = F.create_map(*[F.lit(x) for letter, words in LETTERS.items() for w in words.split() for x in (w, letter)])

    def letter(w: Column) -> Column:
        found = F.when(w.rlike("^[a-z]"), F.coalesce(F.try_element_at(letters, w), F.lit("_")))
        for sign, form in FORMS:
            found = found.when(w.rlike(form), sign)
        return found

    return F.array_join(F.transform(tokens, letter), "")


def reading_sql(tokens: str) -> str:
    """The same in SQL with list lambdas."""
    words = " ".join(f"WHEN w IN ({', '.join(repr(w) for w in words.split())}) THEN '{letter}'" for letter, words in LETTERS.items())
    forms = " ".join(f"WHEN regexp_matches(w, '{form}') THEN '{sign}'" for sign, form in FORMS)
    return f"coalesce(array_to_string(list_transform({tokens}, lambda w: CASE {words} WHEN regexp_matches(w, '^[a-z]') THEN '_' {forms} END), ''), '')"


def _phrase(found: Column, phrase: str) -> tuple[Column, Column]:
    """(tokens before the first such phrase, tokens in it); 0 tokens where there is none."""
    at = rf"^(.*?)({phrase})"
    return F.length(F.regexp_extract(found, at, 1)), F.length(F.regexp_extract(found, at, 2))


def timing_wording(text: Column) -> Column:
    """One of the kinds of ``TIMING``; 'empty' without a word, 'specific' where none hits."""
    said = reading(tokens(text))
    found = F.when(said == "", "empty")
    for kind, hits, unless in TIMING:
        found = found.when(said.rlike(hits) & ~said.rlike(unless) if unless else said.rlike(hits), kind)
    return found.otherwise("specific")


def resolved_day(text: Column, base: Column) -> Column:
    """The date that a plain wording means on the day ``base``; null where it's no plain one. A bare
    weekday that is the day itself may mean either and stays null, unless a part of the day is named."""
    words = tokens(text)
    said, kind = reading(words), timing_wording(text)
    token = lambda phrase, i=0: F.get(words, _phrase(said, phrase)[0] + i)  # noqa: E731  of a phrase that is there
    iso = F.try_to_date(token("I"), "yyyy-MM-dd")
    offset = F.pmod(F.array_position(F.array(*map(F.lit, DAYS)), token("W")).cast("int") - 1 - F.weekday(base), F.lit(7))
    count = token("k[nh][DK]", 1)
    number = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv]), count), count.try_cast("int"), F.lit(1))
    day = F.when(said.rlike("I"), iso).when(said.rlike(f"t|{CLOSE}"), base).when(said.rlike("T"), F.date_add(base, 1))
    day = day.when(said.rlike("W"), F.when((offset != 0) | said.rlike("[xp]"), F.date_add(base, offset)))
    day = day.when(said.rlike("k[nh][DK]"), F.date_add(base, number * F.when(said.rlike("k[nh]K"), 7).otherwise(1)))
    return F.when((kind == "ambiguous_weekday") & (offset == 0), F.date_add(base, 7)).when(kind == "specific", day)


def deadline_wording(text: Column, missing: str = "Not stated") -> Column:
    """The first deadline that the text names, without 'by' or 'on'; ``missing`` where it tells of the past or names none."""
    words = tokens(text)
    said = reading(words)
    before, n = _phrase(said, DEADLINE)
    phrase = F.regexp_replace(F.array_join(F.slice(words, before + 1, n), " "), "^(?:by|on) ", "")
    return F.when((n == 0) | said.rlike(PAST), F.lit(missing)).otherwise(phrase)


#: Words that a unit's worth is told by, and the least words of a unit in which they count. Fixed values.
ACKNOWLEDGING = frozenset("yeah yes ok okay right sure thanks mm no".split())
TECHNICAL = frozenset("audio hear mic mute muted screen".split())
WEIGHTY = (
    ("stakes", 8, frozenset("because blocked delay impact risk".split())),
    ("outcome", 9, frozenset("action agreed deadline decided will".split())),
    ("substance", 10, frozenset("audit budget release report team".split())),
)
#: Units of so few words are of no use.
FEW_WORDS = 5


def usefulness(text: Column) -> tuple[Column, Column]:
    """Label (remove, retain or uncertain) and reason: a reply, a transcriber's mark, talk of the line or too few words
    go; words of weight in a long enough unit stay."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("[a-z0-9']+"), F.lit(0))
    n = F.size(words)
    among = lambda own: F.arrays_overlap(words, F.array(*[F.lit(w) for w in sorted(own)]))
    rules = [
        ("remove", "reply", (n > 0) & (n < 2) & among(ACKNOWLEDGING)),
        ("remove", "mark", low.rlike(r"\[[a-z ]+\]")),
        ("remove", "line", among(TECHNICAL)),
        ("remove", "few words", n <= FEW_WORDS),
        *(("retain", name, (n >= least) & (among(own) if name != "substance" else among(own) | low.rlike("[0-9]"))) for name, least, own in WEIGHTY),
    ]
    label, reason = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for what, why, hit in rules:
        label, reason = label.when(hit, what), reason.when(hit, why)
    return label.otherwise("uncertain"), reason.otherwise("open")


#: Trend by cue; else by status.
TREND_UP, TREND_DOWN = r"ahead of time|trending up|strongly improving", r"declining|slipping|behind schedule|regression|revoked|blocked"


def trend(text: Column, status: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.when(low.rlike(TREND_UP), "improving").when(low.rlike(TREND_DOWN), "deteriorating").when(status == "complete", "resolved")
    return found.when(status.isin("blocked", "awaiting"), "deteriorating").when(status == "in_progress", "stable").otherwise("unknown")


def weekday_issue(text: Column) -> Column:
    """A named weekday beside a date of another weekday, or an nth weekday of a month that its date is
    not: what is wrong, null where nothing is."""
    low = F.lower(text)
    before = rf"\b({DAY})[,:(]? ?(\d{{4}}-\d{{2}}-\d{{2}})"
    after = rf"(\d{{4}}-\d{{2}}-\d{{2}})(?:, ?| ?\()({DAY})\b"
    nth = rf"\b(first|second|third|fourth|fifth|last) ({DAY}) of the month, (\d{{4}}-\d{{2}}-\d{{2}})"
    part = lambda p, i: F.regexp_extract(low, p, i)
    name = lambda d: F.lower(F.date_format(d, "EEEE"))
    day_n = F.try_to_date(part(nth, 3), "yyyy-MM-dd")
    which = F.when(part(nth, 1) == "last", F.month(F.date_add(day_n, 7)) != F.month(day_n)).otherwise(
        F.floor((F.dayofmonth(day_n) - 1) / 7) + 1 == F.array_position(F.array(*map(F.lit, ("first", "second", "third", "fourth", "fifth"))), part(nth, 1))
    )
    day_b, day_a = F.try_to_date(part(before, 2), "yyyy-MM-dd"), F.try_to_date(part(after, 1), "yyyy-MM-dd")
    found = F.when(day_n.isNotNull(), F.when(name(day_n) != part(nth, 2), "weekday").when(~which, "occurrence"))
    return found.when(day_b.isNotNull(), F.when(name(day_b) != part(before, 1), "weekday")).when(day_a.isNotNull(), F.when(name(day_a) != part(after, 2), "weekday"))
