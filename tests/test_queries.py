"""Every registered query against its SQL text on the smallest data."""

from __future__ import annotations

import compare
import pytest

import __spark_entry__ as entry_points

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()
SLOW: set[str] = set()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, folder, database, name):
    difference = compare.differences(QUERIES[name](spark, folder), database, SQL[name])
    assert not difference, difference


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
