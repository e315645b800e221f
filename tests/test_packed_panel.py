"""The panel grown from packed facts: the rows of the joined form, no exchange of grid rows
in a session with default join settings, one read of the rows by the curve summaries."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL
from shelfcast.operators import encode, grid as G
from shelfcast.operators.enrich import build_set
from shelfcast.plans import catalog, prepare
from shelfcast.schema import CATEGORICAL
from shelfcast.sources import star

FACTS = "date date, store_nbr int, item_nbr long, unit_sales double, onpromotion boolean"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(str, df.collect()))


def test_rows_equal_the_joined_panel(spark):
    d0 = dt.date(2016, 1, 1)
    facts = spark.createDataFrame(
        [(d0 + dt.timedelta(days=i % 7), i % 3, i % 41, None if i % 5 == 0 else float(i), [None, True, False][i % 3]) for i in range(90)]
        + [(d0, s, 100, 9.0, True) for s in range(3)], FACTS).dropDuplicates(["date", "store_nbr", "item_nbr"])
    plan = G.packed_plan(facts)
    got = G.packed_panel(facts, plan)
    want = G.zero_fill(facts)
    assert got.columns == want.columns and _rows(got) == _rows(want)


def test_a_key_too_large_for_one_row_keeps_the_join(spark, monkeypatch):
    facts = spark.createDataFrame([(dt.date(2016, 1, 1 + i % 5), i % 3, i, 1.0, False) for i in range(60)], FACTS)
    monkeypatch.setattr(G, "MAX_PACKED_CELLS", 14)
    assert G.packed_plan(facts) is None
    monkeypatch.setattr(G, "MAX_PACKED_CELLS", 15)
    assert G.packed_plan(facts) is not None


def test_training_set_and_categories(spark):
    s, st, it = star.load_star(spark, SF_SMALL)
    facts = prepare.sampled_facts(s, it)
    counts = {**G.key_counts(facts)}
    plan = {**G.plan_grid({**counts, "item_nbr": 10 ** 6}), "partitions": 2}
    plan["values"] = {k: G._inline_values(facts, k) for k in plan["inline"]}
    want = build_set(prepare.train_panel(facts, counts), st, it)
    got = prepare.train_set(facts, st, it, counts, plan)
    assert got.columns == want.columns and _rows(got) == _rows(want)
    ds = prepare.Dataset(got, got, facts, counts, st, it, plan)
    stats = prepare.sparse_stats(ds, st, it)
    tr, _, _ = prepare.normalised(ds, stats)
    whole = prepare.stats.normalise(want, stats)
    assert _rows(tr.select("date", "store_nbr", "item_nbr", F.round("unit_sales", 6))) == _rows(
        whole.select("date", "store_nbr", "item_nbr", F.round("unit_sales", 6)))
    cover = prepare.category_rows(ds, stats)
    assert encode.fit_one_hot(cover, CATEGORICAL) == encode.fit_one_hot(whole, CATEGORICAL)


def test_no_join_or_exchange_above_the_grid_rows(spark):
    """In a default session the alignment join moved every grid row; now an exchange above the
    grid's Generate only carries sums."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    old = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        ds = catalog._ds(spark, "/root/testdata/sf0.01")
        lines = _plan(ds.train).splitlines()
    finally:
        spark.conf.set(key, old)
    gen = next(i for i, l in enumerate(lines) if "Generate explode" in l)
    assert not any("Exchange" in l and "Broadcast" not in l for l in lines[:gen])
    assert "ShuffledHashJoin" not in "".join(lines[:gen]) and "SortMergeJoin" not in "".join(lines[:gen])


def test_curves_without_joins(spark):
    sf = "/root/testdata/sf0.01"
    for df in (catalog._fold_errors(spark, sf, [12]), catalog._month_curve(spark, sf)):
        lines = _plan(df).splitlines()
        gen = max(i for i, l in enumerate(lines) if "Generate explode" in l)
        above = lines[:gen]
        assert sum("Exchange hashpartitioning" in l for l in above) == 1      # the errors by iteration
        assert not any("SortMergeJoin" in l or "ShuffledHashJoin" in l for l in above)
