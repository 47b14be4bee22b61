"""Every registered query of the engine against its SQL, or at least for rows, on the small tables."""

import pytest

from theoremill.plans import registry

from .oracle import compare


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, sf_dir, name):
    compare(spark, sf_dir, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_has_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
