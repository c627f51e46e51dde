"""Every registered query against its SQL check, and a smoke run of the few without one."""

import pytest

import __spark_entry__
import oracle

QUERIES = __spark_entry__.queries()
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, con, sf_dir, key):
    assert oracle.difference(spark, con, QUERIES[key], SQL[key], sf_dir) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, key):
    assert len(QUERIES[key](spark, sf_dir).collect()) > 0


def test_every_check_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 14
    assert min(r["size"] for r in rows) == 6 and min(r["l_c_mktsegment"] for r in rows) == 3
