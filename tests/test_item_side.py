"""The whole item table is never broadcast by the preparation: it grows with the items, the driver doesn't."""

import re

import pytest

from shelfcast.plans import catalog, prepare
from tests.conftest import SF_SMALL


def _joins(df, kind):
    """(join, side) of the item joins in the plan that is about to run."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(\w+Join) \[item_nbr#\d+L?\], \[item_nbr#\d+L?\], " + kind, text)


@pytest.fixture(scope="module")
def ds(spark):
    return prepare.load(spark, SF_SMALL)


def test_statistics_merge_the_items(spark, ds):
    # the other semi joins are with the perishable items, within the persisted facts
    joins = _joins(prepare.sparse_stats(ds, ds.stores, ds.items), "LeftSemi")
    assert joins[0] == "SortMergeJoin"


def test_both_sets_merge_the_items(ds):
    assert _joins(ds.test, "Inner") == ["SortMergeJoin"]
    assert _joins(ds.train, "Inner") == ["SortMergeJoin"]


def test_vocabulary_rows_merge_the_items(spark, ds):
    st = prepare.sparse_stats(ds, ds.stores, ds.items)
    assert set(_joins(prepare.category_rows(ds, st), "Inner")) == {"SortMergeJoin"}


def test_baseline_metrics_unchanged(spark):
    row, = catalog.baseline_metrics(spark, SF_SMALL).collect()
    assert row.n_rows == catalog._ds(spark, SF_SMALL).test.count() - catalog.unseen_items(spark, SF_SMALL).count()
