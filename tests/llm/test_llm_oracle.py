"""Every query on training data against its SQL."""

import pytest
from conftest import DATA, same_rows

from siltstone.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(name, spark, duck):
    same_rows(queries.QUERIES[name], queries.SQL[name], spark, duck)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(name, spark):
    assert queries.QUERIES[name](spark, DATA).count() > 0
