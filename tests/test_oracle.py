"""
(the driver does the same at sf0.01; ``tools/check_oracle.py`` runs it)."""

from __future__ import annotations

import pytest
from conftest import SF001
from oracle_check import compare, duck

import __spark_entry__ as E
from trickle.plans.queries import all_queries

BATCH = [k for k in all_queries() if not k.startswith("stream_")]


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_query_has_an_oracle():
    assert set(all_queries()) <= set(E.queries())
    assert set(all_queries()) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", BATCH)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(E.queries()[name](spark, SF001), con, E.oracle_sql()[name])
    assert ok, msg


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["l_orderkey", "o_orderdate", "o_shippriority", "revenue", "n"]
    assert df.count() == 8
