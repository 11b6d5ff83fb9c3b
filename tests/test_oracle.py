"""Every query that has SQL agrees with it on the smallest supplied tables."""

import os

import pytest

import __spark_entry__ as entry_module
from compare import compare, connection

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    query, sql = entry_module.queries()[name], entry_module.oracle_sql()[name]
    found = compare(spark, con, SF_DIR, query, sql)
    assert found in ([], ["no rows on either side"]), "\n".join(found)


def test_entry(spark):
    assert entry_module.entry(spark).columns[0] == "customer_id"


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
