"""Every registered query with a DuckDB twin gives the twin's result."""

import pytest

from oracle_check import compare, connect
from swipesight.plans import catalog

SMALL = "/root/testdata/sf0.001"
QUERIES = catalog.entries()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_matches_its_twin(spark, duck, name):
    assert compare(QUERIES[name](spark, SMALL), duck, QUERIES[name].sql) is None


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
