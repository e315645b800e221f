"""A hot item (a third of all facts) does not skew the zero-filled grid: every
item gets exactly dates x stores rows, and the hot item's values survive."""

import datetime as dt

from pyspark.sql import functions as F

from shelfcast.operators import grid as G


def test_hot_item_does_not_skew_grid(spark):
    d0 = dt.date(2016, 1, 1)
    hot = [(d0 + dt.timedelta(days=i), s, 1, 1.0, False) for i in range(40) for s in range(5)]   # 200 rows
    cold = [(d0 + dt.timedelta(days=i % 40), i % 5, 2 + i, 2.0, None) for i in range(400)]        # 400 rows
    facts = spark.createDataFrame(hot + cold, "date date, store_nbr int, item_nbr long, unit_sales double, onpromotion boolean")
    z = G.zero_fill(facts)
    per_item = {r.item_nbr: r.n for r in z.groupBy("item_nbr").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(per_item.values()) == {40 * 5}
    assert len(per_item) == 401
    tot = z.agg(F.sum("unit_sales")).collect()[0][0]
    assert tot == 200 * 1.0 + 400 * 2.0
    # partitions hold whole items, so no task gets more than its items' share
    sizes = [r.n for r in z.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) <= 200 * (401 // len(sizes) + 40)
