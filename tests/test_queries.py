"""Each query against its SQL, over the smallest tables; the driver's contract."""

import pytest

from loomgraph.plans import registry
from tests.compare import database, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf, db, name):
    mine, theirs = same(spark, db, sf, QUERIES[name], SQL[name])
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"w0_stated_payloads"}))  # tests/test_rewrites.py has that
def test_without_sql_runs(spark, sf, name):
    found = QUERIES[name](spark, sf)
    assert found.columns and found.collect()


def test_every_oracle_has_a_query():
    assert not set(SQL) - set(QUERIES)
