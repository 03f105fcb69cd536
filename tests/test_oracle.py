"""Every registered query next to its SQL; queries without SQL must run and give rows."""

import os

import pytest
from compare import compare, duck

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], SQL.get(name), SF_DIR) == ""


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "feature"


def test_names():
    assert set(SQL) <= set(QUERIES)
