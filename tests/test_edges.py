"""Edge tables with expected values (null / IEEE rules, calendar, grid, keys,
encodings, metrics, patience, CV summary, key hash)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from shelfcast.functions.calendar import date_features
from shelfcast.functions.keyhash import key_hash
from shelfcast.functions.numeric import zscore
from shelfcast.operators import encode, evaluate, grid as G, sample, stats
from shelfcast.operators.enrich import enrich_dims

D = dt.date


def test_zscore_ieee_rules(spark):
    rows = [(0.0, 0.0), (2.0, 0.0), (-2.0, None), (None, 2.0), (None, None), (5.0, 2.5)]
    df = spark.createDataFrame(rows, "d double, s double")
    got = [r[0] for r in df.select(zscore(F.col("d"), F.lit(0.0), F.col("s"))).collect()]
    assert math.isnan(got[0])
    assert got[1] == float("inf")
    assert got[2] == float("-inf")
    assert got[3] == 0.0
    assert math.isnan(got[4])
    assert got[5] == 2.0


def test_item_stats_one_row_and_all_null(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (2, 4.0), (3, None), (3, None)],
                               "item_nbr long, unit_sales double")
    got = {r.item_nbr: (r.mean, r.std) for r in stats.item_stats(df).collect()}
    assert got[1] == (1.0, None)
    assert got[2][0] == 3.0 and abs(got[2][1] - 1.41421356) < 1e-8
    assert got[3] == (None, None)


def test_calendar(spark):
    df = date_features(spark.createDataFrame([(D(2016, 1, 1),)], "date date"))
    r = df.collect()[0]
    assert (r.month, r.week_of_year, r.day_of_week) == (1, 53, 4)
    n = df.select(F.date_format("date", "MMMM"), F.date_format("date", "EEEE")).collect()[0]
    assert tuple(n) == ("January", "Friday")


def test_period_filter_inclusive(spark):
    df = spark.createDataFrame([(D(2015, 12, 31),), (D(2016, 1, 1),), (D(2016, 12, 31),), (D(2017, 1, 1),)], "date date")
    got = sorted(r.date for r in sample.sample_period(df, "2016-01-01", "2016-12-31").collect())
    assert got == [D(2016, 1, 1), D(2016, 12, 31)]


def _facts(spark):
    return spark.createDataFrame(
        [(D(2016, 1, 1), 1, 1, 5.0, True), (D(2016, 1, 2), 2, 1, 3.0, None), (D(2016, 1, 2), 1, 2, None, False)],
        "date date, store_nbr int, item_nbr long, unit_sales double, onpromotion boolean")


def test_grid_fill(spark):
    facts = _facts(spark)
    z = G.zero_fill(facts)
    rows = z.collect()
    assert len(rows) == 8
    assert sum(r.unit_sales for r in rows) == 8.0
    assert sum(1 for r in rows if r.unit_sales == 0) == 6
    assert all(r.unit_sales is not None and r.onpromotion is not None for r in rows)


def test_oversized_key_sets_become_blocks(spark):
    assert G.plan_grid({"date": 10, "store_nbr": 500, "item_nbr": 1000}, max_inline=100)["blocks"] == {"store_nbr": 5}
    assert G.plan_grid({"date": 10, "store_nbr": 500, "item_nbr": 1000})["blocks"] == {}


def test_duplicate_keys_raise(spark):
    df = _facts(spark).unionByName(_facts(spark).limit(1))
    with pytest.raises(ValueError):
        sample.assert_unique_key(df)
    sample.assert_unique_key(_facts(spark))


def test_dimension_gap_drops_rows(spark):
    panel = _facts(spark)
    stores = spark.createDataFrame([(1, "c", "s", "A", 1)], "store_nbr int, city string, state string, type string, cluster int")
    items = spark.createDataFrame([(1, "f", 1, 1), (2, "g", 1, 1)], "item_nbr long, family string, class int, perishable int")
    assert enrich_dims(panel, stores, items).count() == 2


def test_label_codes_and_unseen(spark):
    tr = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "state string")
    te = spark.createDataFrame([("c",), ("a",)], "state string")
    a, b, _ = encode.label_encode(tr, te, ["state"], as_int=True)
    assert sorted(set(tuple(r) for r in a.collect())) == [(0,), (1,), (2,)]
    assert [r.state for r in b.collect()] == [2, 0]
    bad = spark.createDataFrame([("d",)], "state string")
    with pytest.raises(Exception):
        encode.label_encode(tr, bad, ["state"])[1].collect()


def test_one_hot(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "t string")
    vocab = encode.fit_one_hot(df, ["t"])
    out = encode.one_hot(df, vocab)
    assert out.columns == ["t_a", "t_b"]
    assert [tuple(r) for r in out.collect()] == [(0, 1), (1, 0), (0, 0)]
    tr = spark.createDataFrame([("a",), ("b",)], "t string")
    te = spark.createDataFrame([("b",)], "t string")
    assert encode.one_hot(te, encode.fit_one_hot(tr, ["t"])).columns == ["t_a", "t_b"]


def test_mape(spark):
    a = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0)], "y double, prediction double")
    assert evaluate.metrics(a, "r").collect()[0].mape_status == "+inf"
    b = spark.createDataFrame([(2.0, 1.0), (4.0, 5.0)], "y double, prediction double")
    assert abs(evaluate.metrics(b, "r").collect()[0].mape - 37.5) < 1e-9


def test_rmse_pooled_vs_per_day(spark):
    df = spark.createDataFrame([(0, 3.0, 0.0), (1, 0.0, 0.0), (1, 0.0, 0.0), (1, 1.0, 0.0)],
                               "day_of_week int, y double, prediction double")
    got = {r.segment: r.rmse for r in evaluate.metrics_rollup(df, "r").collect()}
    assert abs(got["Monday"] - 3.0) < 1e-6
    assert abs(got["Tuesday"] - 0.57735) < 1e-6
    assert abs(got["all"] - 1.581139) < 1e-6


def test_patience(spark):
    vals = [5, 4, 4, 3.5, 3.6, 3.5, 3.7, 3.0]
    h = spark.createDataFrame([("r", i + 1, float(v)) for i, v in enumerate(vals)], "run string, iteration int, rmse double")
    r = evaluate.early_stop(h, 3).collect()[0]
    assert (r.stop_iteration, r.best_iteration) == (7, 4)


def test_cv_summary(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("A", 3.0), ("B", 5.0), ("B", 5.0)], "setting string, rmse double")
    got = {r.setting: (r.rmse_mean, r.rmse_std) for r in evaluate.cv_summary(df).collect()}
    assert got["A"][0] == 2.0 and abs(got["A"][1] - 0.816497) < 1e-6
    assert got["B"] == (5.0, 0.0)


def test_key_hash(spark):
    df = spark.createDataFrame([(1, 2, D(2016, 1, 1))], "store_nbr int, item_nbr long, date date")
    assert df.select(key_hash(None, "store_nbr", "item_nbr", "date")).collect()[0][0] == 3355865333


def test_metrics_leave_out_non_finite_rows(spark):
    rows = [(1, 2.0, 1.0), (1, 4.0, 5.0), (1, float("inf"), 1.0), (1, None, 1.0), (1, 3.0, float("nan"))]
    df = spark.createDataFrame(rows, "day_of_week int, y double, prediction double")
    for r in (evaluate.metrics(df, "r").first(), *evaluate.metrics_rollup(df, "r").collect()):
        assert (r.n_rows, r.n_non_finite, r.mape_status) == (5, 3, "finite")
        assert abs(r.mape - 37.5) < 1e-6 and abs(r.rmse - 1.0) < 1e-6


@pytest.mark.parametrize("size", [0.05, 0.1, 0.15, 0.2, 0.25, 0.5])
def test_split_takes_any_fraction(spark, size):
    from shelfcast.functions.keyhash import key_hash, train_flag
    df = spark.range(40000).selectExpr("cast(id % 50 as int) store_nbr", "id item_nbr", "date '1996-01-01' date")
    share = 1 - df.filter(train_flag(test_size=size)).count() / 40000
    assert abs(share - size) < 0.01
    if size == 0.2:   # the membership of the plain tenths
        assert df.filter(train_flag(test_size=size) != (key_hash(42, "store_nbr", "item_nbr", "date") % 10 < 8)).count() == 0
