"""Queries with a DuckDB twin give the twin's result on whole tables."""

import pytest

from oracle_check import compare, connect
from swipesight.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_twin(spark, duck, name):
    assert compare(queries.entries()[name](spark, SMALL), duck, queries.oracle_sql()[name]) is None
