"""Correctness gate: every registered query equals its DuckDB twin at sf0.01
(row count, column names, order-insensitive values)."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from learnlens.plans import queries  # noqa: E402
from oracle_check import canon, duck  # noqa: E402

from conftest import SF001  # noqa: E402

# The subpackage for training data has its own tests.
NAMES = sorted(queries.registered())


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_query_has_an_oracle():
    assert set(queries.oracle()) == set(queries.registered()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, con, name):
    df = entry.queries()[name](spark, SF001)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[name])
    want = cur.fetchall()
    ocols = [d[0] for d in cur.description]
    c1, r1 = canon(df.columns, got)
    c2, r2 = canon(ocols, want)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["user_id", "course_id", "week"]
    assert df.schema == entry.entry(spark).schema
