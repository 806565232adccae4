"""Every registered query beside its SQL on the smallest scale, and the contract of the entry module."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import check, connect

SF = os.environ.get("TIDEMARK_TEST_SF", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    n, problem = check(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert problem is None
    assert n >= 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
