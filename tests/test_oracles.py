"""Every query that has SQL gives the same rows as DuckDB."""

import os

import pytest

import oracle
from tidelog import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_same_rows(spark, con, name):
    assert oracle.compare(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
