"""Every query against its DuckDB SQL, and every other query for rows."""

import pytest
from compare import same_rows

from tessera.plans import registry


@pytest.mark.parametrize("key", sorted(registry.ORACLE))
def test_oracle(spark, duck, sf_dir, key):
    same_rows(spark, duck, sf_dir, registry.QUERIES[key], registry.ORACLE[key])


@pytest.mark.parametrize("key", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_rows(spark, sf_dir, key):
    assert registry.QUERIES[key](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
