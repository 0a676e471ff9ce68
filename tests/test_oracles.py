"""Every core query that has SQL against DuckDB, every other one for rows and a second run."""

from __future__ import annotations

import pytest

from prosegauge.plans import registry

from .conftest import duck, same_rows


@pytest.fixture(scope="module")
def con(tiny):
    return duck(tiny)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, tiny, con, name):
    same_rows(registry.QUERIES[name](spark, tiny), con, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_and_repeats(spark, tiny, name):
    first = sorted(map(str, registry.QUERIES[name](spark, tiny).collect()))
    assert first and first == sorted(map(str, registry.QUERIES[name](spark, tiny).collect()))


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
