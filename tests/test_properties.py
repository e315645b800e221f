"""Properties of the prepared dataset on the driver's sf0.001 tables."""

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import evaluate, grid as G, split, stats
from shelfcast.plans import prepare
from shelfcast.sources import star
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def ds(spark):
    return prepare.load(spark, SF_SMALL)


def test_grid_is_product(ds):
    c = ds.counts
    g = G.grid(ds.facts, counts=c)
    assert g.count() == c["date"] * c["store_nbr"] * c["item_nbr"]
    assert g.distinct().count() == g.count()


def test_fill_preserves_sum(ds):
    panel = prepare.train_panel(ds.facts, ds.counts)
    a = panel.agg(F.sum("unit_sales")).collect()[0][0]
    b = ds.facts.agg(F.sum("unit_sales")).collect()[0][0]
    assert abs(a - b) < 1e-6


def test_zscore_mean0_std1(ds):
    tr, _, _ = prepare.normalised(ds)
    s = stats.item_stats(tr).filter(F.col("std").isNotNull()).collect()
    assert s and all(abs(r["mean"]) < 1e-9 and abs(r["std"] - 1) < 1e-9 for r in s)


def test_dense_equals_sparse(spark, ds):
    st, it = star.stores(spark, SF_SMALL), star.items(spark, SF_SMALL)
    dense = {r.item_nbr: (r.mean, r.std) for r in stats.item_stats(ds.train).collect()}
    sparse = {r.item_nbr: (r.mean, r.std) for r in prepare.sparse_stats(ds, st, it).collect()}
    assert dense.keys() == sparse.keys()
    for k in dense:
        assert abs(dense[k][0] - sparse[k][0]) < 1e-9
        assert abs(dense[k][1] - sparse[k][1]) < 1e-9


def test_folds_partition_rows(ds):
    f = split.assign_fold(ds.train.select("date", "store_nbr", "item_nbr"), 5)
    n = ds.train.count()
    assert f.count() == n
    assert {r.fold for r in f.select("fold").distinct().collect()} == set(range(5))


def test_split_independent_of_partitioning(ds):
    base = ds.train.select("date", "store_nbr", "item_nbr")
    a = {tuple(r) for r in split.with_split(base).filter("is_train").collect()}
    b = {tuple(r) for r in split.with_split(base.repartition(3)).filter("is_train").collect()}
    assert a == b


def test_pooled_rmse_identity(spark, ds):
    tr, te, _ = prepare.normalised(ds)
    scored = te.select("day_of_week", F.col("unit_sales").alias("y"), F.lit(0.0).alias("prediction"))
    rows = evaluate.metrics_rollup(scored, "r").collect()
    pooled = [r for r in rows if r.segment == "all"][0]
    days = [r for r in rows if r.segment != "all"]
    w = sum(r.n_rows * r.rmse ** 2 for r in days) / sum(r.n_rows for r in days)
    assert abs(w - pooled.rmse ** 2) < 1e-4
