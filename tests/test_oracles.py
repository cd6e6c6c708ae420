import pytest

from __spark_entry__ import entry, oracle_sql, queries
from hourweave.registry import QUERIES
from oracles.compare import connect, differences
from oracles.queries import SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert len(entry(spark).columns) == 24


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert differences(queries()[name](spark, SF), con, oracle_sql()[name]) == []
