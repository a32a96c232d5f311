"""Every query against its SQL on the small tables."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from quillwork.plans import registry


@pytest.fixture(scope="session")
def con(small: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def lines(rows) -> list[str]:
    return sorted(repr(tuple(map(plain, r))) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, small, name):
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    sql = registry.ORACLE_SQL[name].strip().rstrip(";")
    assert sorted(con.sql(sql).columns) == columns
    want = con.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({sql}) as q").fetchall()
    assert lines(df.select(*[f"`{c}`" for c in columns]).collect()) == lines(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs_and_has_unique_columns(spark, small, name):
    df = registry.QUERIES[name](spark, small)
    assert len(set(df.columns)) == len(df.columns)
    again = lines(registry.QUERIES[name](spark, small).collect())
    assert lines(df.collect()) == again  # the same rows each time


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
