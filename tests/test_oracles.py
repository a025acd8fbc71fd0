"""Every registered query runs, and equals its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from workloads.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, message


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
