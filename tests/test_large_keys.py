"""Vocabularies that don't pass through the driver, reports without the grid, bucketed datasets."""

import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import SF_SMALL
from shelfcast.operators import encode, report, stats
from shelfcast.plans import catalog, prepare
from shelfcast.schema import CATEGORICAL, KEY
from shelfcast.sources import files, star


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_rank_table_numbers_the_sorted_values(spark):
    values = [f"v{i * 7919 % 5003:05d}" for i in range(5003)]
    df = spark.createDataFrame([(v,) for v in values * 2] + [(None,)], "c string").repartition(13)
    got = {r.value: r.code for r in encode.rank_table(df, "c").collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}
    assert encode.rank_table(df.limit(0), "c").count() == 0
    odd = spark.createDataFrame([("é",), ("z",), ("",), ("Z",)], "c string")
    assert [r.value for r in encode.rank_table(odd, "c").orderBy("code").collect()] == sorted(["é", "z", "", "Z"])


def test_rank_codes_equal_the_label_codes(spark):
    tr, te, _ = catalog._normalised(spark, SF_SMALL)
    _, want, _ = encode.label_encode(tr, te, CATEGORICAL, as_int=True)
    with pytest.raises(ValueError):
        encode.fit_one_hot(tr, CATEGORICAL, max_categories=2)       # the bound of the inline form
    a, got, tables = encode.label_encode_by_rank(tr, te, CATEGORICAL)
    assert rows(got, *KEY, *CATEGORICAL) == rows(want, *KEY, *CATEGORICAL)
    assert a.count() == tr.count() and set(tables) == set(CATEGORICAL)


def test_rank_codes_refuse_unseen_values(spark):
    tr = spark.createDataFrame([("a",), ("b",)], "c string")
    for bad in ("x", None):
        te = spark.createDataFrame([("a",), (bad,)], "c string")
        with pytest.raises(PySparkException, match="unseen value"):
            encode.label_encode_by_rank(tr, te, ["c"])[1].collect()


def test_sparse_one_hot_equals_the_columns(spark):
    tr, te, _ = catalog._normalised(spark, SF_SMALL)
    odd = te.limit(3).withColumns({"family": F.lit(None).cast("string"), "type": F.lit("unseen")})
    te = te.unionByName(odd)
    vocab = encode.fit_one_hot(tr, CATEGORICAL)
    names = encode.one_hot_columns(vocab)
    want = rows(encode.one_hot(te.select(*KEY, *CATEGORICAL), vocab), *KEY, *names)
    got_train, got, sizes = encode.one_hot_vectors(tr, te, CATEGORICAL)
    assert sizes == {c: len(vocab[c]) for c in CATEGORICAL}
    vectors = got.select(*KEY, "one_hot").collect()
    assert all(r.one_hot.size == len(names) for r in vectors)
    assert sorted([(*[r[k] for k in KEY], *[int(x) for x in r.one_hot.toArray()]) for r in vectors], key=repr) == want
    assert not set(CATEGORICAL) & set(got_train.columns)


def test_family_reports_equal_the_panel(spark):
    ds = catalog._ds(spark, SF_SMALL)
    st, it = star.stores(spark, SF_SMALL), star.items(spark, SF_SMALL)
    # a store and an item without a dimension row, which the panel's joins drop
    st, it = st.filter("store_nbr % 3 <> 0"), it.filter("item_nbr % 5 <> 0")
    panel = prepare.build_set(prepare.train_panel(ds.facts, ds.counts), st, it)
    n = ds.facts.select("store_nbr").distinct().join(st, "store_nbr", "left_semi").count()
    assert rows(report.sales_by_family_sparse(ds.facts, st, it, n), "*") == rows(report.sales_by_family(panel), "*")
    for by in ("month", "day_of_week", "week_of_year"):
        got = report.mean_by_family_sparse(ds.facts, st, it, by, n)
        want = report.mean_by_family(panel, by)
        assert got.dtypes == want.dtypes and rows(got, "*") == rows(want, "*")
        families = report.families_sparse(ds.facts, it)
        wide = report.pivot_means(got, by, families)
        assert rows(wide, by, *families) == rows(report.pivot_by_family(panel, by, families), by, *families)
    none = ds.facts.limit(0)
    assert report.mean_by_family_sparse(none, st, it, "month", n).count() == 0
    assert report.sales_by_family_sparse(none, st, it, n).count() == 0
    assert report.sales_by_family_sparse(ds.facts, st.limit(0), it, 0).count() == 0


def test_bucketed_dataset_needs_no_exchange(spark, tmp_dir):
    ds = catalog._ds(spark, SF_SMALL)
    name = f"bucketed_{uuid.uuid4().hex[:8]}"
    saved = files.save_bucketed(ds.train, tmp_dir, name, buckets=4)
    assert rows(saved, *KEY, "unit_sales", "month") == rows(ds.train, *KEY, "unit_sales", "month")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        st = stats.item_stats(saved)
        assert "Exchange" not in plan_of(st)
        joined = stats.normalise(saved, st)
        assert "Exchange" not in plan_of(joined) and "Join" in plan_of(joined)
        dense = stats.normalise(ds.train, stats.item_stats(ds.train))
        assert rows(joined.select(*KEY, F.round("unit_sales", 6).alias("z")), "*") == \
            rows(dense.select(*KEY, F.round("unit_sales", 6).alias("z")), "*")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    one = saved.filter("month = 3")
    assert "PartitionFilters: [isnotnull(month" in plan_of(one)


def test_bucketed_dataset_declared_in_another_session(spark, tmp_dir):
    ds = catalog._ds(spark, SF_SMALL)
    name = f"bucketed_{uuid.uuid4().hex[:8]}"
    saved = files.save_bucketed(ds.train, tmp_dir, name, buckets=4)
    want, schema = rows(saved, *KEY, "unit_sales"), saved.schema
    spark.sql(f"DROP TABLE {files.table_name(tmp_dir, name)}")           # an external table: its files stay
    again = files.load_bucketed(spark, tmp_dir, name, schema, buckets=4)
    assert rows(again, *KEY, "unit_sales") == want
    assert "Exchange" not in plan_of(stats.item_stats(again))


def test_caches_belong_to_an_application(spark):
    assert all(k[0] == spark.sparkContext.applicationId for k in catalog._DS_CACHE)


def test_one_scan_for_all_weekdays(spark):
    assert plan_of(catalog.union_days(spark, SF_SMALL)).count("Union") == 0


def test_jobs_on_a_bucketed_dataset(spark, tmp_dir):
    from shelfcast.plans import jobs
    jobs.job_prepare(spark, SF_SMALL, tmp_dir, buckets=4)
    ds = jobs._saved_dataset(spark, SF_SMALL, tmp_dir, buckets=4)
    assert "Exchange" not in plan_of(stats.item_stats(prepare.sample.fill_missing(ds.train)))
    few = {"max_iter": 2, "max_depth": 3, "min_instances": 5}
    got = jobs.job_train_trees(spark, SF_SMALL, tmp_dir, buckets=4, **few)
    want = jobs.job_train_trees(spark, SF_SMALL, tmp_dir, **few)
    assert rows(got.metrics, "rmse", "n_rows") == rows(want.metrics, "rmse", "n_rows")
