from __future__ import annotations

import pytest

import __spark_entry__ as entries
from lexstrata.plans.registry import QUERIES, SQL
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same(spark, sf_dir, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0


def test_entry(spark):
    assert entries.entry(spark).count() > 0


def test_registry():
    assert set(entries.oracle_sql()) <= set(entries.queries())
