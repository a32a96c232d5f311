"""Dates and times in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Sorts after every time of day.
NO_TIME = 1_000_000_000


def quarter_start(d: Column) -> Column:
    return F.trunc(d, "quarter")


def quarter_end(d: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))


def quarter_label(d: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(d), F.lit(" "), F.year(d))


def strict_date(text: Column) -> Column:
    """A date of the form YYYY-MM-DD that exists; null else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def clock_seconds(text: Column) -> Column:
    """Seconds of m:s or h:m:s; NO_TIME for anything else."""
    parts = F.split(text, ":")
    at = lambda i: F.try_element_at(parts, F.lit(i)).cast("long")
    ok = text.rlike(r"^\d+(:[0-5]?\d){1,2}$")
    return F.when(ok & (F.size(parts) == 2), at(1) * 60 + at(2)).when(ok, at(1) * 3600 + at(2) * 60 + at(3)).otherwise(F.lit(NO_TIME).cast("long"))


def weekday_contradicts(text: Column) -> Column:
    """A named weekday and a date of another weekday; null if either is missing."""
    low = F.lower(text)
    named = F.regexp_extract(low, "(" + "|".join(DAYS) + ")", 1)
    day = strict_date(F.regexp_extract(low, r"(\d{4}-\d{2}-\d{2})", 1))
    return F.when((named != "") & day.isNotNull(), named != F.lower(F.date_format(day, "EEEE")))


def timing_kind(text: Column) -> Column:
    """First rule that fits."""
    rules = [("recurrence", "every|weekly|daily|monthly"), ("range", "between|from .* to "), ("bound", r"\bby |before|until"), ("period", "next|this"), ("specific", r"\d{4}-\d{2}-\d{2}")]
    low, found = F.lower(text), F.when(F.lit(False), "")
    for kind, pattern in rules:
        found = found.when(low.rlike(pattern), kind)
    return found.otherwise("none")


def resolve(text: Column, base: Column) -> Column:
    """The date that words mean on a day; null if it isn't plain. A bare weekday that is the day
    itself stays null, as it may mean either; 'next' takes the one after."""
    low = F.lower(F.trim(text))
    number = F.regexp_extract(low, r"^in (\d+) (day|week)s?$", 1).cast("int")
    unit = F.when(low.rlike(r"^in \d+ weeks?$"), 7).otherwise(1)
    found = F.when(low == "today", base).when(low == "tomorrow", F.date_add(base, 1)).when(low.rlike(r"^in \d+ (day|week)s?$"), F.date_add(base, number * unit))
    for day in DAYS:
        following = F.next_day(base, day[:3])
        found = found.when(low == f"next {day}", following).when((low == day) & (F.lower(F.date_format(base, "EEEE")) != day), following)
    return found


def deadline(text: Column, missing: str = "Not stated") -> Column:
    """First pattern that hits, unless the text tells of something done."""
    patterns = [r"by (\d{4}-\d{2}-\d{2})", r"due (\w+)", r"before (\w+)", r"until (\w+)"]
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns], F.lit(missing))
    return F.when(text.rlike(r"\b(was|were) (done|sent|finished)\b"), F.lit(missing)).otherwise(found)


def plain_dates(text: Column) -> Column:
    """'the 23rd of July' as '23 July'."""
    s = F.regexp_replace(text, r"\b(?:the )?(\d{1,2})(?:st|nd|rd|th)(?: of)?(?= [A-Z])", "$1")
    for day in DAYS:
        s = F.regexp_replace(s, rf"\b{day}\b", day.capitalize())
    return s


def expand_range(text: Column, year: int) -> tuple[Column, Column]:
    """Both ends of '27 to 7 August': where the first day is later, it's in the month before."""
    p = r"(\d{1,2}) (?:to|-) (\d{1,2}) (\w+)"
    first, last, month = (F.regexp_extract(text, p, i) for i in (1, 2, 3))
    end = F.try_to_date(F.concat_ws(" ", last, month, F.lit(str(year))), "d MMMM yyyy")
    start = F.try_to_date(F.concat_ws(" ", first, month, F.lit(str(year))), "d MMMM yyyy")
    same = first.try_cast("int") <= last.try_cast("int")
    before = F.add_months(F.trunc(end, "month"), -1)
    return F.when(same, start).otherwise(F.date_add(before, first.try_cast("int") - 1)), end
