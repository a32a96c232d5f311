"""Queries over turns' wording, on a table of sentences that hit their rules: each against its SQL."""

from __future__ import annotations

import shutil
from pathlib import Path

import duckdb
import pytest

from quillwork.plans import discourse, registry
from tests.test_oracles import lines

WORDINGS = (
    "Every Monday we meet", "The audit is on 2024-03-15", "Send it no earlier than Friday", "We will not do it on Tuesday", "They met last Wednesday",
    "Monday or Tuesday suits", "By end of day please", "In the second week of the project", "Between March and May", "Finish before Thursday",
    "Once the client confirms, start", "It takes three weeks", "Within five working days of receipt", "On Friday", "The 3rd of April works", "Around 7 people came",
    "Next month we release the report", "Next Monday is fine", "Tomorrow morning", "In two weeks", "01/02/2024 was said", "Last year was hard",
    "By 12 April 2024 the team will send the budget", "On the next working day after the launch", "By close Friday", "At 9:30 am tomorrow", "The first week after our launch",
    "Before lunch", "Call them this evening", "By the end of this week", "At the start of next sprint", "Ahead of the next review", "Before submission",
    "This sprint", "After the board has approved", "During the meeting we agreed", "It was reviewed last week by Friday", "Thanks", "[inaudible]", "Can you hear me now at the back",
    "We are blocked because the release slipped and the budget is behind schedule", "The team agreed that they will close the audit report soon", "We are trending up and done",
    "Waiting for the other side", "Friday, 2024-03-15", "Monday 2024-03-15", "2024-03-15 (Tuesday)", "The third Friday of the month, 2024-03-15", "The second Friday of the month, 2024-03-15",
    "The last Friday of the month, 2024-03-29", "Ask Maria to call, Maria will know", "Tell Jonas to wait, then Jonas can go", "Not started yet",
)
TURNS = (
    "Could you send the budget by Friday?", "No, we cannot do that", "I'll send it tomorrow", "Agreed, sounds good", "Quick recap of the actions",
    "Maria, you are on the report", "Jonas, you are calling the client", "Yes, I am doing the audit", "Yes, agreed", "Thanks everyone, see you",
    "There is a problem with the release", "We will finish the report and close the issue", "Maybe, it is unclear to me", "What do you mean by that?",
    "I prefer the first option", "Rather take the other approach", "Fine", "Right, anything else?", "The risk is the dependency on the client team", "Let's release the new option before Monday",
    "Please call the board and ask for the budget", "We agreed on the approach", "Not sure", "Next topic: the audit of the budget and the team",
)
MORE = (
    "We were told about it last week", "This Wednesday", "Wednesday then", "in a week", "3 March", "May 4th, or later", "today or tomorrow", "each working day", "until Friday", "at the earliest on Monday",
    "not until May", "12:30 pm tomorrow", "the end of the day", "close of business", "The first week of the sprint", "the 2nd week of May", "for two days", "they met yesterday", "Ask Maria and tell Jonas to wait for Maria", "Jonas will call Maria",
    "Maria will help; Jonas can go", "The budget report of the audit team is ready and the release is planned now", "He said no", "ok", "Yes.", "The agenda item was agreed, and the team will decide on the action by then", "", "I am on mute", "2024-02-30 works", "v1.2.3 and 4/5/2024",
    "Meeting Title\nANN LEE 00:12\n[Ann joined]\n\nWe own the release", "She is responsible for the data", "The first step of the process", "The figures shows 12", "Please send it",
)
#: Queries that read the wording of turns.
NAMES = sorted(
    {name for m in (discourse, registry.wording) for name in m.queries.found}
    | {"grounded_attributions", "claims_compared", "insight_facets", "sampled_actions", "evidence_ledger", "specialists", "status_from_text", "sentence_bucket", "noise_turns", "trailing_questions", "turns_around_questions", "decision_topics"}
)


@pytest.fixture(scope="module")
def sentences(spark, small, tmp_path_factory) -> str:
    folder = tmp_path_factory.mktemp("sentences")
    for f in Path(small).glob("*.parquet"):
        if f.stem != "conversations":
            shutil.copy(f, folder)
    every = [*WORDINGS, *TURNS, *MORE]
    roles = ("user", "assistant", "user", "assistant", "system")
    # Each sentence at several places, beside different neighbours; some conversations repeat one, and one turn has no text.
    rows, i = [], 0
    for c in range(80):
        for turn in range(2 + c % 6):
            i += 1
            text = TURNS[2] if c % 10 == 5 and turn % 2 == 0 else every[i * 11 % len(every)]
            text = ("Ask Maria to send the report", "Maria will send it by Friday", "Jonas, please call them")[turn % 3] if c % 10 == 7 else text
            rows.append((c, turn, roles[(c + turn) % 5], text if i > 1 else None))
    assert len(every) % 11 and len(rows) > 2 * len(every)
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{folder}/made")
    (part,) = Path(folder, "made").glob("*.parquet")
    shutil.move(part, folder / "conversations.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def con(sentences) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(sentences).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql_on_sentences(spark, con, sentences, name):
    df = registry.QUERIES[name](spark, sentences)
    columns = sorted(df.columns)
    got = lines(df.select(*[f"`{c}`" for c in columns]).collect())
    assert got
    if name in registry.ORACLE_SQL:
        sql = registry.ORACLE_SQL[name].strip().rstrip(";")
        assert got == lines(con.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({sql}) as q").fetchall())


@pytest.mark.parametrize(
    ("name", "column", "least"),
    [("timing_wordings", "kind", 13), ("resolved_days", "day", 20), ("deadline_wordings", "deadline", 20), ("usefulness_labels", "reason", 7), ("trends_of_turns", "trend", 4), ("weekday_issues", "issue", 2), ("people_mentioned", "name", 2), ("tiers_of_actions", "tier", 2), ("status_from_text", "status", 3), ("grounded_attributions", "owner", 2), ("grounded_attributions", "claimed", 3), ("sentence_bucket", "bucket", 9), ("denoise_reasons", "reason", 5)],
)
def test_the_rules_are_hit(spark, sentences, name, column, least):
    assert registry.QUERIES[name](spark, sentences).select(column).distinct().count() >= least
