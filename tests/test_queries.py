"""Every registered query against its SQL."""

import pytest
from conftest import same_as_duckdb

from lorekeep import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    same_as_duckdb(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows and all(any(v is not None for v in r) for r in rows)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
