"""Every query of the subpackage over tables without rows and over rows of nulls with more columns."""

import pytest

from paperlake.llm import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty(spark, empty_tables, name):
    assert registry.QUERIES[name](spark, empty_tables).collect() == []


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_nulls(spark, null_tables, name):
    rows = registry.QUERIES[name](spark, null_tables).collect()
    assert len(rows) == (2 if name == "p6_ids" else 0)
