"""Every query with a twin gives the rows of its twin."""

import pytest
from duck import oracle, same

from tracewright.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_duckdb(spark, small, name):
    same(registry.QUERIES[name](spark, small).toPandas(), oracle(registry.ORACLES[name], small))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_twins_have_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
