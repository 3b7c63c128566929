"""Operators whose result SQL can express."""

from __future__ import annotations

import pytest

from flowmill.llm import queries

from ..compare import compare, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name]) == ""
