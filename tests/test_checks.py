"""Every registered query against its checking SQL, on the smallest tables."""

import pytest
from helpers import SMALL

from workload.checks import CHECKS
from workload.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    from compare import connect

    return connect(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, con, name):
    from compare import differences

    assert differences(QUERIES[name](spark, SMALL), con, CHECKS[name]) == []


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() >= 1
