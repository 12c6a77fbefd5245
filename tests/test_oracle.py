"""Every registered query against its DuckDB oracle on the smallest driver
tables (the driver repeats this at sf0.01)."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import duck, rows_of  # noqa: E402

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_an_oracle():
    from logmart.plans.catalog import QUERIES
    missing = set(QUERIES) - set(E.oracle_sql())
    assert not missing


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["rank", "id"]
    assert df.count() >= 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, sf_dir, name):
    df = E.queries()[name](spark, sf_dir)
    cols, srows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    dcols, drows = [d[0] for d in res.description], res.fetchall()
    assert sorted(cols) == sorted(dcols)
    assert len(srows) == len(drows)
    assert rows_of(cols, srows) == rows_of(dcols, drows)
