"""Every query of the core against its SQL."""

import pytest
from conftest import DATA, same_rows

from siltstone.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(name, spark, duck):
    same_rows(registry.QUERIES[name], registry.SQL[name], spark, duck)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(name, spark):
    assert registry.QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
