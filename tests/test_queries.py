"""Every core query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from skein.plans import code_queries, data_queries, index_queries
from tests.compare import compare, duck

NAMES = [*code_queries.QUERIES, *index_queries.QUERIES, *data_queries.QUERIES]


@pytest.fixture(scope="module")
def con(small):
    pytest.importorskip("duckdb")
    return duck(small)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small, con, name):
    said = compare(spark, con, name, small)
    assert said in ("", "no rows"), said


def test_entry_runs(spark, small):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
