"""Every registered query against its SQL on the smallest data."""

import os

import oracle
import pytest

import __spark_entry__ as contract

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", contract.workloads.QUERIES)
def test_query(spark, db, name):
    frame = contract.queries()[name](spark, SF)
    assert oracle.difference(frame, db, contract.oracle_sql()[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0
