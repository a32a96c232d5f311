"""claims_compared on turns of which it is known in what they differ; its SQL's verdict on order hangs on a hash table, all else is the same."""

from __future__ import annotations

import shutil
from pathlib import Path

import duckdb
import pytest

from quillwork.plans import registry

#: A conversation each: its turns, and in what each differs from the next.
TALKS = (
    (("The report Ci read De sent", "The memo De wrote Ci read"), ["order"]),
    (("That plan, The draft", "That is so, said The Ing"), [""]),
    (("Ann met Bob, Ann left", "Ann, Zed and Bob"), [""]),
    (("Bob met Ann, Bob left", "Ann, Zed and Bob, Ann"), ["order"]),
    (("Ann alone", "Bob and Ann"), [""]),
    (("Carl, Dora, Emil", "Emil, Dora, Carl?", "Emil, Carl, Dora at least"), ["asks,order", "asks,bounded,order"]),
    (("Noñas que", "Ann says never", "niño", "ifé"), ["", "negated", "conditional"]),
    (("no", None, "by then"), ["negated", "bounded"]),
)


@pytest.fixture(scope="module")
def talks(spark, small, tmp_path_factory) -> str:
    folder = tmp_path_factory.mktemp("talks")
    for f in Path(small).glob("*.parquet"):
        if f.stem != "conversations":
            shutil.copy(f, folder)
    rows = [(c, turn, ("user", "assistant")[turn % 2], text) for c, (texts, _) in enumerate(TALKS) for turn, text in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{folder}/made")
    (part,) = Path(folder, "made").glob("*.parquet")
    shutil.move(part, folder / "conversations.parquet")
    return str(folder)


def test_names_count_in_the_order_in_which_they_are_first_said(spark, talks):
    got = {(r.conv_id, r.turn): r.differs for r in registry.QUERIES["claims_compared"](spark, talks).collect()}
    assert got == {(c, turn): differs for c, (_, wanted) in enumerate(TALKS) for turn, differs in enumerate(wanted)}


@pytest.mark.parametrize("table", ["talks", "small"])
def test_all_but_order_equals_the_sql(spark, request, table):
    folder = request.getfixturevalue(table)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{folder}/conversations.parquet')")
    but_order = lambda rows: sorted((c, turn, [x for x in differs.split(",") if x not in ("", "order")]) for c, turn, differs in rows)
    want = con.sql(f"select conv_id, turn, differs from ({registry.ORACLE_SQL['claims_compared']}) q").fetchall()
    got = registry.QUERIES["claims_compared"](spark, folder).select("conv_id", "turn", "differs").collect()
    assert want and but_order(got) == but_order(want)
