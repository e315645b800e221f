"""Every SQL-expressible registered query against its DuckDB oracle (sf0.001)."""

import pytest

from conftest import SF_MID, SF_SMALL
from oracle_check import compare, duck

import __spark_entry__ as E

SQL = E.oracle_sql()


# their columns are the vocabulary, of which the smallest tables lack a value
WIDE = {"month_family_pivot", "dow_family_pivot", "one_hot"}


@pytest.fixture(scope="module")
def con():
    return {d: duck(d) for d in (SF_SMALL, SF_MID)}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    sf = SF_MID if name in WIDE else SF_SMALL
    ok, n, _, _, detail = compare(spark, con[sf], name, E.queries()[name], SQL[name], sf)
    assert ok, detail


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle_can_be_stored_as_a_view(con, name):
    con[SF_SMALL].execute(f'CREATE OR REPLACE TEMP VIEW "v_{name}" AS {SQL[name]}')


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["family", "month", "unit_sales_mean"]


def test_every_query_registered_has_callable():
    assert set(SQL) <= set(E.queries())
