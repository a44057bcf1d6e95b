"""Every registered query against its SQL, on the smallest tables."""

import os

import oracle
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(contract.QUERIES) == set(contract.ORACLES)


@pytest.mark.parametrize("name", list(contract.oracle_sql()))
def test_query(spark, con, name):
    assert oracle.differences(contract.queries()[name](spark, SF_DIR), con, contract.oracle_sql()[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() == 200
