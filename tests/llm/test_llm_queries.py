"""Every training-text query runs on the smallest tables, and equals its SQL where it has one."""

import pytest

from skein.llm import queries
from tests.compare import compare, duck


@pytest.fixture(scope="module")
def con(small):
    pytest.importorskip("duckdb")
    return duck(small)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, small, con, name):
    said = compare(spark, con, name, small)
    assert said in ("", "no rows"), said


def test_no_case_twice(spark, small):
    for name in ("p1_found", "p5_found", "p8_found", "p9_found"):
        df = queries.QUERIES[name](spark, small)
        assert df.count() == df.distinct().count()
