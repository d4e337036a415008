"""Every registered query runs; every oracle query matches DuckDB (sf0.001 here)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle import compare, duck

ORACLE = E.oracle_sql()
QUERIES = E.queries()


def test_contract():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 58


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["token", "id", "freq"]
    assert df.count() > 0


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, con, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = con.execute(ORACLE[name]).fetchdf()
    assert compare(got, want) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0
