"""Every registered query against its SQL; the others at least run."""

import pytest

from tests.conftest import SF
from tracewright import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(name, agree):
    agree(registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLE_SQL.keys()))
def test_runs(name, spark):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
