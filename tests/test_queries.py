"""Every registered query against its SQL twin, on whole tables at the smallest scale."""

import os

import pytest
from oracle import compare, duck

from cuewright.plans.registry import catalog

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
CATALOG = catalog()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, con, name):
    run, sql = CATALOG[name]
    error, _ = compare(spark, con, SF_DIR, run, sql)
    assert error is None, error


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
