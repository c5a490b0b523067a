"""Every registered query runs and equals its oracle SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import differences, duck
from tripweave.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert name in ORACLES
    diff, rows = differences(spark, con, name, QUERIES[name], ORACLES[name], FOLDER)
    assert diff is None and rows > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
