"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import pytest

from flowmill.plans import registry

from .compare import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert compare(registry.QUERIES[name](spark, sf_dir), con, registry.ORACLES[name]) == ""
