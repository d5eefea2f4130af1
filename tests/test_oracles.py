"""Every query with SQL agrees with DuckDB on the given tables, value by value."""

import os

import pytest

import __spark_entry__  # noqa: F401  registers the queries
from prismill.plans.registry import ORACLES
from tests.oracle import compare, connection

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, name) is None
