"""Every named query against its SQL on the smallest given tables."""

import os

import pytest

from compare import connect, differences, spark_result, sql_result
from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")

RUNS, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_query(spark, duck, name):
    got = spark_result(RUNS[name](spark, SF))
    if name in SQL:
        assert differences(got, sql_result(duck, SQL[name])) is None
    else:
        assert got[1]


def test_entry(spark):
    assert entry(spark).columns == ["date", "total_orders", "total_revenue", "unique_customers"]


def test_sql_belongs_to_a_query():
    assert set(SQL) <= set(RUNS)
