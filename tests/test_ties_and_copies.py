"""Ties that an order leaves open stand as in the files; copies of a wording are compared once."""

from __future__ import annotations

import datetime

import duckdb
import pytest

from quillwork.plans import merging, registry
from tests.test_oracles import lines


def equals_its_sql(spark, folder, name) -> list[str]:
    con = duckdb.connect()
    for table in ("customer", "nation", "orders", "lineitem", "part"):
        if (folder / f"{table}.parquet").exists():
            con.sql(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    df = registry.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = lines(df.select(*columns).collect())
    sql = registry.ORACLE_SQL[name].strip().rstrip(";")
    assert got == lines(con.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({sql}) as q").fetchall())
    return got


def test_lines_of_one_number_and_part_stand_as_in_the_file(spark, tmp_path):
    con, day = duckdb.connect(), datetime.datetime(1995, 1, 2)
    tables = {
        "customer": "SELECT 1 AS c_custkey, 1 AS c_nationkey", "nation": "SELECT 1 AS n_nationkey, 'X' AS n_name", "orders": f"SELECT 7 AS o_orderkey, 1 AS o_custkey, TIMESTAMP '{day}' AS o_orderdate, 'F' AS o_orderstatus",
        "lineitem": "SELECT 7 AS l_orderkey, 3 AS l_partkey, 2 AS l_linenumber, unnest(['O', 'F', 'O']) AS l_linestatus, 'R' AS l_returnflag",
    }
    for name, sql in tables.items():
        con.sql(f"copy ({sql}) to '{tmp_path}/{name}.parquet'")
    (row,) = equals_its_sql(spark, tmp_path, "whole_contexts")
    assert "2O,2F,2O" in row


@pytest.mark.parametrize("copies", [40])
def test_copies_of_a_wording_are_compared_once(spark, tmp_path, copies, monkeypatch):
    said = ["large ring", "large bolt", "hot bolt", "ring large", "small nut", "hot ring"]
    rows = [(i, said[i // 2 % 6 if i % 3 else 0], "Brand#1", ("LARGE", "hot")[i % 5 // 3], 1 + i % 2 * (i % 7 == 0)) for i in range(6 * copies)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    df = registry.QUERIES["carried_rows"](spark, str(tmp_path))
    columns = sorted(df.columns)
    want = con.sql("select " + ", ".join(columns) + f" from ({registry.ORACLE_SQL['carried_rows']}) as q").fetchall()
    assert lines(df.select(*columns).collect()) == lines(want)
    assert "least" in df._jdf.queryExecution().optimizedPlan().toString()  # pairs are of wordings


@pytest.mark.parametrize("people", [590, 3 * 576])
def test_people_of_one_name_are_compared_once(spark, tmp_path, people, monkeypatch):
    con, sizes, kept = duckdb.connect(), [], merging.written

    def counted(df):
        sizes.append(df.count())
        return kept(df)

    monkeypatch.setattr(merging, "written", counted)
    con.sql(f"copy (SELECT range AS s_suppkey FROM range({people})) to '{tmp_path}/supplier.parquet'")
    con.sql(f"create view supplier as select * from read_parquet('{tmp_path}/supplier.parquet')")
    df = registry.QUERIES["people_resolved"](spark, str(tmp_path))
    columns = sorted(df.columns)
    want = con.sql("select " + ", ".join(columns) + f" from ({registry.ORACLE_SQL['people_resolved']}) as q").fetchall()
    assert lines(df.select(*columns).collect()) == lines(want)
    assert sizes and max(sizes) <= 576  # names and wordings repeat after so many people


def test_matches_of_wordings_are_those_of_their_rows(spark, tmp_path):
    """Copies, ties over several wordings and words of their own, against the sequential choice over all pairs of rows."""
    said = ["large ring", "large bolt", "hot bolt", "ring large", "small nut", "hot ring", "", "Ring ring"]
    rows = [(i * 7919 % 2003, said[i * i % 8], f"Brand#{i % 3}", ("LARGE", "hot", "old tin")[i % 5 % 3], 1) for i in range(240)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    words, want = {r[0]: set(f"{r[1]} {r[3]}".lower().split()) for r in rows}, set()
    for grp in {r[2] for r in rows}:
        mine, used = [r[0] for r in rows if r[2] == grp], set()
        pairs = [(-round(len(words[a] & words[b]) / len(words[a] | words[b]), 6), a, b) for a in mine if a % 2 == 0 for b in mine if b % 2]
        for low, a, b in sorted(p for p in pairs if p[0] <= -0.38):
            if a not in used and b not in used:
                used |= {a, b}
                want.add((f"{grp}/1", a, b, -low))
    df = registry.QUERIES["jaccard_matches_used_once"](spark, str(tmp_path))
    assert {tuple(r) for r in df.collect()} == want and len(want) > 80
    assert "wording_a" in df._jdf.queryExecution().optimizedPlan().toString()  # pairs are of wordings
