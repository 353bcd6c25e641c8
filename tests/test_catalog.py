"""Every registered query against its SQL; queries without one against what is known of them."""

import pytest

from siltstone import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_gives_what_its_sql_gives(name, compare):
    compare(catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_has_rows_and_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
