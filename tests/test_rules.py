"""Rules on wording, transcripts and outside calls, by hand-made cases."""

from __future__ import annotations

import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillwork.functions import wording
from quillwork.operators import external, publishing, transcripts
from quillwork.operators.ranks import nearest_rank, ranked_values


def said(spark, texts, *columns):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [tuple(r)[1:] for r in rows.select("i", *columns).orderBy("i").collect()]


TIMING = [
    ("every other Tuesday", "recurrence"), ("we meet on Mondays", "recurrence"), ("01/02/24", "ambiguous_numeric_date"), ("last year", "past_period"), ("not before May", "bound"), ("never on Monday", "negated"),
    ("last Friday", "past_period"), ("Monday or Tuesday", "range"), ("close of business", "specific"), ("the second week of May work", "ordinal_period"), ("from 3rd to 5th", "range"), ("before Friday", "bound"),
    ("once they confirm", "dependency"), ("it takes two weeks", "duration"), ("five working days", "business_interval"), ("on Friday", "specific"), ("2024-05-01", "specific"), ("roughly then", "approximate"),
    ("next month", "period"), ("next Monday", "ambiguous_weekday"), ("", "empty"), (None, "empty"), ("in two weeks", "specific"),
]


def test_kinds_of_timing(spark):
    assert [k for (k,) in said(spark, [t for t, _ in TIMING], wording.timing_wording(F.col("s")))] == [k for _, k in TIMING]


def test_days_that_words_mean(spark):
    base = F.lit("2024-03-13").cast("date")  # a Wednesday
    cases = {"today": "2024-03-13", "tomorrow": "2024-03-14", "on Friday": "2024-03-15", "Wednesday": None, "Wednesday morning": "2024-03-13", "next Wednesday": "2024-03-20", "next Friday": None, "in two weeks": "2024-03-27", "within 3 days": "2024-03-16", "2024-02-30": None, "2024-05-01": "2024-05-01", "some day": None, None: None}
    found = said(spark, list(cases), wording.resolved_day(F.col("s"), base).cast("string"))
    assert [d for (d,) in found] == list(cases.values())


def test_deadlines(spark):
    cases = {
        "Send it by 12 April 2024 please": "12 april 2024", "It was done by Friday last week": "Not stated", "on the next working day after launch, then": "the next working day after launch", "by close Friday": "close friday",
        "before lunch": "before lunch", "by the end of this month": "the end of this month", "ahead of the next review": "ahead of the next review", "after the board has approved": "after the board has approved", "no date": "Not stated", None: "Not stated",
    }
    assert [d for (d,) in said(spark, list(cases), wording.deadline_wording(F.col("s")))] == list(cases.values())


def test_weekdays_against_dates(spark):
    cases = {"Friday, 2024-03-15": None, "Monday 2024-03-15": "weekday", "2024-03-15 (Tuesday)": "weekday", "the third Friday of the month, 2024-03-15": None, "the second Friday of the month, 2024-03-15": "occurrence", "the last Friday of the month, 2024-03-29": None, "2024-02-30 Friday": None, "nothing": None}
    assert [d for (d,) in said(spark, list(cases), wording.weekday_issue(F.col("s")))] == list(cases.values())


def test_usefulness_and_trend(spark):
    label, reason = wording.usefulness(F.col("s"))
    cases = {"Yes.": ("remove", "reply"), "the report [inaudible] was late": ("remove", "mark"), "too short here": ("remove", "few words"), "we think that there is a risk of delay here": ("retain", "stakes"), "all of the people here are glad about their work": ("uncertain", "open")}
    assert said(spark, list(cases), label, reason) == list(cases.values())
    status = F.lit("complete")
    assert said(spark, ["we are slipping", "ahead of time", "all fine"], wording.trend(F.col("s"), status)) == [("deteriorating",), ("improving",), ("resolved",)]


LAYOUTS = {
    "below": "Ann O'Neill   0:03\nGood morning.\nHow are you?\nBjörn Lind   0:05\nFine.",
    "glued": "Ann O'Neill   0:03Good morning. How are you?\nBjörn Lind   0:05Fine.",
    "colon": "Ann O'Neill: Good morning. How are you?\nBjörn Lind: Fine.",
    "stamped": "[00:00:03] Ann O'Neill: Good morning. How are you?\n[00:00:05] Björn Lind: Fine.",
    "one line": "Ann O'Neill: Good morning. How are you? Björn Lind: Fine.",
    "windows": "Ann O'Neill: Good morning. How are you?\r\nBjörn Lind: Fine.\r\n",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_every_layout_gives_the_same_turns(layout):
    assert transcripts.parse(LAYOUTS[layout]) == [("Ann O'Neill", "Good morning. How are you?"), ("Björn Lind", "Fine.")]


SPEAKERS = {
    "numbered": ("Speaker 1: hello there\nSpeaker 2: and you\nSpeaker 1: fine", [("Speaker 1", "hello there"), ("Speaker 2", "and you"), ("Speaker 1", "fine")]),
    "one number": ("Speaker 1: hello", [("Speaker 1", "hello")]),
    "labels": ("Ann Lee: hi\nReminder: bring it\nWhat I Think: no\nBob Ray: yes", [("Ann Lee", "hi Reminder: bring it What I Think: no"), ("Bob Ray", "yes")]),
    "short names": ("Ann: hi\nBob: yes\nAnn: so\nBob: right", [("Ann", "hi"), ("Bob", "yes"), ("Ann", "so"), ("Bob", "right")]),
    "first name": ("Ann Lee: hi\nAnn: again", [("Ann Lee", "hi"), ("Ann", "again")]),
    "time within": ("Ann Lee: at 10:30: the call\nBob Ray   00:02:11\nWords: many", [("Ann Lee", "at 10:30: the call"), ("Bob Ray", "Words: many")]),
    "mixed": (
        "Claire Nolan 00:12\nWe opened.\n00:12:30 priya.raman: The audit.\n00:14:00 tom_oneill: The deadline.\nClaire Nolan 00:15\nRight.",
        [("Claire Nolan", "We opened."), ("Unattributed", "The audit."), ("Unattributed", "The deadline."), ("Claire Nolan", "Right.")],
    ),
    "particles": ("Ludwig van Beek: yes\nO'Neill 0:05 no", [("Ludwig van Beek", "yes"), ("O'Neill", "no")]),
}


@pytest.mark.parametrize("case", SPEAKERS)
def test_who_speaks_is_judged_by_the_whole_text(case):
    text, want = SPEAKERS[case]
    assert transcripts.parse(text) == want


@given(st.lists(st.sampled_from(["Ann Lee", "Ann", "priya.raman", "Note", ":", " ", "\n", "0:12", "[00:01:02]", "Hello there.", "What", "Speaker 1", ": ", "x", "é", "\t"]), max_size=25).map("".join))
def test_every_character_is_in_a_turn_or_a_region(text):
    found = transcripts.pieces(text)
    assert "".join(text[p.begin : p.end] for p in found) == text
    assert all(p.begin <= p.words <= p.end for p in found) and [p.kind for p in found[1:]].count("region") == 0
    # The plain version: each header found starts a turn, and nothing else does.
    assert [p.begin for p in found if p.kind == "turn"] == [h.begin for h, _ in transcripts.headers(text)]
    assert all(p.speaker == transcripts.NO_ONE or p.speaker.split(" ")[0].lower() not in transcripts.LABELS for p in found if p.kind == "turn")


def test_regions_that_no_one_spoke(spark):
    rows = [(1, "Opening words\nAnn Lee: hi"), (2, "no header at all"), (3, None), (4, "")]
    got = transcripts.pieces_of(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()
    assert [(r["id"], r["kind"], r["begin"], r["end"]) for r in got] == [(1, "region", 0, 14), (1, "turn", 14, 25), (2, "region", 0, 16)]


def test_handles_labels_and_long_turns():
    turns = transcripts.parse("Meeting of May\nAnn Lee: We start.\nNote: this is no speaker\npriya.raman: hello there\nSPEAKER_02: second\ntom: third\nAgenda: lunch")
    assert turns == [("Ann Lee", "We start. Note: this is no speaker"), ("Unattributed", "hello there"), ("Unattributed", "second"), ("Unattributed", "third Agenda: lunch")]
    long = transcripts.parse("Ann Lee: " + "A sentence of words. " * 600)
    assert len(long) > 2 and all(s == "Ann Lee" and len(x) <= 5000 for s, x in long) and " ".join(x for _, x in long) == ("A sentence of words. " * 600).strip()
    assert transcripts.parse(None) == transcripts.parse("") == transcripts.parse("no header at all") == []


def test_calls_keep_their_order_and_tell_the_first_error(spark, tmp_path):
    def call(text: str, attempt: int) -> str:
        time.sleep(0.02 if text == "a" else 0)
        if text in ("x", "y") or (text == "b" and attempt < 3):
            raise ValueError(text)
        return text.upper()

    rows = spark.createDataFrame(list(enumerate(["a", "b", "y", "a", "x", "c", None])), "i int, s string").coalesce(1)
    got = [(r.answer, r.error, r.attempts) for r in external.answered(rows, "s", call, in_flight=4).collect()]
    assert got == [("A", None, 1), ("B", None, 3), (None, "ValueError: y", 3), ("A", None, 1), (None, "ValueError: x", 3), ("C", None, 1), ("", None, 1)]
    assert [tuple(r) for r in external.first_error(external.answered(rows.filter("i < 6"), "s", call), "i").collect()] == [(2, "ValueError: y")]


def test_scripts_that_hang_or_fail_are_told(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string").coalesce(1)
    for script, error in (("import time; time.sleep(60)", "timeout"), ("raise SystemExit(3)", "CalledProcessError"), ("print('[1]')", "not an answer for each text"), ("print('{')", "JSONDecodeError")):
        assert {r.error for r in external.scripted(rows, "s", script, seconds=2.0).collect()} == {error}
    good = external.scripted(rows, "s", "import json, sys; print(json.dumps([x * 2 for x in json.load(sys.stdin)]))").collect()
    assert [(r.answer, r.error) for r in good] == [('"aa"', None), ('"bb"', None)]


def test_posts_are_tried_again_and_every_row_has_a_status(spark, tmp_path):
    log = str(tmp_path / "log")

    def post(records: list[dict]) -> int:
        with open(log, "a") as f:
            f.write(",".join(str(r["i"]) for r in records) + ";")
        return 503 if open(log).read().count(";") == 1 else 200

    rows = spark.range(25).selectExpr("cast(id as int) as i").coalesce(1)
    assert [r.status for r in external.posted(rows, post, batch=10).collect()] == [200] * 25
    sent = open(log).read().split(";")[:-1]
    assert len(sent) == 4 and sent[0] == sent[1] and [int(x) for s in sent[1:] for x in s.split(",")] == list(range(25))


def test_a_version_is_seen_by_its_manifest_only(spark, tmp_path):
    folder = f"file://{tmp_path}/published"
    one = publishing.publish(spark, folder, {"a": spark.range(3), "b": spark.range(5)})
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    with pytest.raises(Exception, match="no"):
        publishing.publish(spark, folder, {"a": spark.range(9), "b": bad})
    assert publishing.published(spark, folder, "a", one).count() == 3 and publishing.published(spark, folder, "b", one).count() == 5
    with pytest.raises(ValueError, match="isn't published"):
        publishing.published(spark, folder, "c", one)


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [5.0] * 7, [3.0, -1.0, None, 8.5, 8.5, 0.0], list(map(float, range(2000)))])
def test_ranks_are_exact(spark, values):
    rows = spark.createDataFrame([(k, v) for k in ("a", None) for v in values], "k string, v double")
    known = sorted(v for v in values if v is not None)
    found = ranked_values(rows, ["k"], "v", {"low": F.lit(1), "p50": nearest_rank(0.5), "p90": nearest_rank(0.9), "high": F.col("n")}).collect()
    at = lambda q: known[max(1, -(-int(q * 100) * len(known) // 100)) - 1]
    assert len(found) == 2
    for r in found:
        assert (r.low, r.p50, r.p90, r.high) == (known[0], at(0.5), at(0.9), known[-1])
