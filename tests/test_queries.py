"""Every registered query against its SQL on the smallest test tables."""

import pytest

import __spark_entry__ as entry
from compare import difference, duck

SQL = entry.oracle_sql()
OWN = set(entry.queries()) - set(entry.llm.queries() if entry.llm else ())
QUERIES = {name: query for name, query in entry.queries().items() if name in OWN}
SQL = {name: sql for name, sql in SQL.items() if name in OWN}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_queries_are_built_without_a_session():
    assert all(callable(q) for q in QUERIES.values())


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, SQL[name]) is None
