"""Every query runs on the smallest data; those with SQL agree with it."""

import pytest

from scriptoria.plans import registry
from tests.parity import compare, connect

NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="session")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf, name):
    if name in registry.ORACLES:
        assert compare(spark, con, sf, name, registry.QUERIES[name], registry.ORACLES[name]) is None
    else:
        assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
