"""The queries of this subpackage against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from lexweave.llm import queries
from test_entry import compare, duck  # noqa: F401


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_sql(spark, duck, name):  # noqa: F811
    compare(spark, duck, name)


def test_all_are_registered():
    assert set(queries.QUERIES) <= set(entry.queries())
    for n in (1, 2, 3, 5, 8):
        assert f"p{n}_found" in queries.QUERIES
