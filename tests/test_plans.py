"""Plan shape: no Python UDF in the SQL-checkable queries, dimensions
broadcast, filters pushed to the scan, the grid not shuffled on its key."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_no_python_udf(spark, name):
    p = _plan(E.queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p


def test_dimensions_broadcast_and_pushdown(spark):
    p = _plan(E.queries()["sample_perishable"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in p


def test_grid_generated_not_joined(spark):
    p = _plan(E.queries()["zero_fill"](spark, SF_SMALL))
    assert "Generate explode" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_grid_rows_not_shuffled(spark):
    """Between the alignment join and the grid's Generate there is no Exchange:
    only the facts (the build side) are repartitioned."""
    lines = _plan(E.queries()["zero_fill"](spark, SF_SMALL)).splitlines()
    join = next(i for i, l in enumerate(lines) if "ShuffledHashJoin" in l)
    gen = next(i for i, l in enumerate(lines) if "Generate explode" in l and i > join)
    assert not any("Exchange" in l for l in lines[join + 1:gen])
