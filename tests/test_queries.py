"""Registered queries against DuckDB on the smallest tables."""

import pytest

from checks import compare
from checks.oracles import ORACLES
from checks.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return compare.connect(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    assert compare.difference(spark, con, SMALL, name) == ""
