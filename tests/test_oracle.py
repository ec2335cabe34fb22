"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as registered
from checks.compare import differences, duckdb_connection
from conftest import SMALL

QUERIES, ORACLES = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duckdb_connection(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connection, name):
    frame = QUERIES[name](spark, SMALL)
    if name in ORACLES:
        assert differences(frame, connection, ORACLES[name]) is None
    else:
        assert frame.count() > 0


def test_entry(spark):
    assert registered.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
