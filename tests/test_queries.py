"""Every core query over tables without rows and over rows of nulls with more columns."""

import pytest

from paperlake.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty(spark, empty_tables, name):
    df = registry.QUERIES[name](spark, empty_tables)
    rows = df.collect()
    assert df.columns and len(rows) <= 1  # totals may give one row


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_nulls(spark, null_tables, name):
    assert len(registry.QUERIES[name](spark, null_tables).collect()) <= 6
