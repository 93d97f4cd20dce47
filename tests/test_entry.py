"""The registered queries against their SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
LLM = [f"p{n}_" for n in (1, 2, 3, 5, 6, 7, 8)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set memory_limit='4GB'")
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def compare(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == Counter(tuple(row[i] for i in at) for row in result.fetchall())


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith(tuple(LLM))])
def test_query_matches_sql(spark, duck, name):
    compare(spark, duck, name)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
