"""Every registered query against its oracle statement, on the smallest given tables."""

import pytest

import __spark_entry__ as contract
from check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    verdict, rows, _ = compare(spark, con, SF, name)
    assert verdict in ("ok", "rows-only"), verdict
    assert rows >= 0


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
