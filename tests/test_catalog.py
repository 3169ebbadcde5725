"""Every named query against its SQL text on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import connect, spark_table, sql_table

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = spark_table(entry.queries()[name](spark, SF_DIR))
    assert got == sql_table(con, entry.oracle_sql()[name])


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row.merged_total == row.base + row.secondary_only
