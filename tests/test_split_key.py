"""The split's hash is taken once a row, and from the text that the panel carries once an item and date."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from shelfcast.functions.keyhash import key_hash, train_flag
from shelfcast.operators import split
from shelfcast.plans import catalog, prepare


@pytest.mark.parametrize("size", [0.1, 0.2, 0.25, 0.3, 0.7, 0.9])
def test_tenths_are_judged_as_by_the_whole_number(spark, size):
    keys = spark.range(20_000).select(F.col("id").alias("store_nbr"))
    h = key_hash(42, "store_nbr")
    place = (h % 10 + F.floor(h / 10) / F.lit(float(2 ** 32 // 10 + 1))) / 10
    assert keys.filter((place < F.lit(round(1.0 - size, 9))) != train_flag(42, size, ["store_nbr"])).count() == 0


def test_a_filter_on_the_split_hashes_once(spark):
    df = spark.range(9).select(F.col("id").alias("store_nbr"), F.col("id").alias("item_nbr"), F.current_date().alias("date"))
    plan = split.with_split(df).filter("is_train").select("store_nbr")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"md5\(", plan)) == 1


def test_carried_text_gives_the_same_sides_and_folds(spark):
    tr = catalog._normalised(spark, SF_SMALL)[0]
    keyed = catalog._keyed_rows(spark, SF_SMALL)
    assert split.ITEM_DATE in keyed.columns and split.ITEM_DATE not in tr.columns
    for f in (split.with_split, lambda df: split.assign_fold(df, 5)):
        a, b = f(tr), f(keyed)
        assert a.columns == b.columns
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    ds = catalog._ds(spark, SF_SMALL)
    joined = prepare.train_set(ds.facts, ds.stores, ds.items, ds.counts, None, item_date=True)
    assert sorted(map(str, split.with_split(joined).collect())) == sorted(map(str, split.with_split(ds.train).collect()))
