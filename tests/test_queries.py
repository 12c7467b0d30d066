"""Every catalog query against its SQL, and the entry points."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from shelfline import queries as q
from tests.compare import connection, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_matches_sql(spark, sf_dir, con, name):
    same(q.QUERIES[name](spark, sf_dir), con, q.ORACLES[name])


def test_entry_points(spark):
    assert entry.entry(spark).columns == ["id", "path", "size", "write_time"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(q.QUERIES) <= set(entry.queries())
