"""Every registered query runs on the smallest tables and gives its SQL's rows."""

import pytest
from oracle_compare import compare, connect

from lintlake.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok is not False, note


def test_entry_contract():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
