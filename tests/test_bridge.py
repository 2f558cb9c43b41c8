import os

import pytest

from compare import SF, assert_same
from logloom.plans import bridge


@pytest.mark.parametrize("name", sorted(bridge.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, name, os.environ.get("TEST_SF_DIR", SF))


@pytest.mark.parametrize("name", sorted(set(bridge.QUERIES) - set(bridge.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert bridge.QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
