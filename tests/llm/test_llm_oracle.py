"""Queries with SQL against DuckDB on the smallest tables."""

import pytest

from strandframe.llm.queries import CORPUS
from tests.llm.conftest import SF
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", [n for n, q in CORPUS.items() if q.sql is not None])
def test_query_matches_sql(spark, name):
    ok, message = compare(spark, connect(SF), CORPUS[name], SF)
    assert ok, message
