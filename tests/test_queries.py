"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import SMALL
from oracle import compare, duck

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    ok, note = compare(spark, con, SMALL, name, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns[:4] == ["h3_id", "time_bin", "day_type", "n_visitors"]
    assert rows.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
