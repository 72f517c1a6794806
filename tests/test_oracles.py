"""Every named query against its checking SQL."""

import pytest
from oracle import compare, duck

from wardlight.plans import catalog


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, folder, con, name):
    rows, problem = compare(catalog.QUERIES[name](spark, folder), con, catalog.ORACLES[name])
    assert problem is None, f"{name}: {problem}"


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, folder, name):
    assert catalog.QUERIES[name](spark, folder).count() > 0
