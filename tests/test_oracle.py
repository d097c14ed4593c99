"""Every registered query against its SQL twin on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    run, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        df = run(spark, SF_DIR)
        assert df.columns and df.count() > 0
    else:
        assert compare(spark, con, run, sql, SF_DIR) is None


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
