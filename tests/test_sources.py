"""Dirty CSV, key checks and sketches in the pass, metric commits, grids of any size."""

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import grid as G, sample
from shelfcast.plans import jobs
from shelfcast.sources import files

STORES = "store_nbr,city,state,type,cluster\n1,Quito,P,A,1\n2,Loja,L,B,2\n"
ITEMS = "item_nbr,family,class,perishable\n10,BREAD,7,1\n11,DAIRY,8,1\n12,TOOLS,9,0\n"


def sales(extra=()):
    lines = ["id,date,store_nbr,item_nbr,unit_sales,onpromotion"]
    lines += [f"{k},{y}-01-0{1 + k % 5},{1 + k % 2},{10 + k // 10 % 3},{k}.5,{['True', 'False', ''][k % 3]}" for y in (2016, 2017) for k in range(30)]
    return "\n".join([*lines, *extra]) + "\n"


def put(tmp_dir, **texts):
    out = {}
    for name, text in texts.items():
        out[name] = f"{tmp_dir}/{name}.csv"
        with open(out[name], "w") as f:
            f.write(text)
    return out


PERIODS = {"train_period": ("2016-01-01", "2016-12-31"), "test_period": ("2017-01-01", "2017-12-31")}


def test_prepare_from_dirty_csv(spark, tmp_dir):
    p = put(tmp_dir, sales=sales(["broken", "901,2016-01-01,x,10,1.0,True", "902,2016-13-45,1,10,1.0,True", "903,,1,10,1.0,True",
                                  "904,2016-01-01,1,10,1.0,True,more"]), stores=STORES, items=ITEMS)
    got = jobs.job_prepare(spark, None, f"{tmp_dir}/out", p["sales"], p["stores"], p["items"], **PERIODS)
    rejects = spark.read.parquet(f"{tmp_dir}/out/results/rejects").collect()
    assert got["rejected"] == {"all": 5, "malformed": 4} and {r.reason for r in rejects} == {"malformed", "no date"}
    assert "broken" in {r.line for r in rejects} and all(r.file.endswith("sales.csv") for r in rejects)
    train = spark.read.parquet(f"{tmp_dir}/out/data/train_{jobs.TRAIN_NAME}")
    assert train.count() == got["counts"]["date"] * got["counts"]["store_nbr"] * got["counts"]["item_nbr"] == 5 * 2 * 2
    jobs.job_train_trees(spark, None, f"{tmp_dir}/out", max_iter=1, max_depth=2, min_instances=2)
    jobs.job_train_trees(spark, None, f"{tmp_dir}/out", max_iter=1, max_depth=2, min_instances=2)      # a retry
    m = spark.read.parquet(f"{tmp_dir}/out/results/metrics")
    assert m.count() == 2 and m.select("run").distinct().count() == 1


def test_prepare_refuses_repeated_keys(spark, tmp_dir):
    p = put(tmp_dir, sales=sales(["77,2016-01-01,1,10,3.0,True"]), stores=STORES, items=ITEMS)
    with pytest.raises(ValueError, match="repeated keys"):
        jobs.job_prepare(spark, None, f"{tmp_dir}/out", p["sales"], p["stores"], p["items"], **PERIODS)


def test_rejects_do_not_depend_on_the_selected_columns(spark, tmp_dir):
    p = put(tmp_dir, sales=sales(["901,2016-01-01,1,10,notanumber,True"]))
    good, bad = files.checked_sales(spark, p["sales"])
    assert good.select("date").count() == 60 and bad.select("reason").count() == 1


def test_metrics_of_other_runs_stay(spark, tmp_dir):
    rows = lambda run, v: spark.createDataFrame([(run, "rmse", v), (run, "mape", v)], "run string, metric string, value double")
    for run, v in (("a", 1.0), ("b", 2.0), ("a", 3.0)):
        files.append_metrics(rows(run, v), tmp_dir + "/m")
    assert sorted((r.run, r.value) for r in spark.read.parquet(tmp_dir + "/m").collect()) == [("a", 3.0)] * 2 + [("b", 2.0)] * 2


def test_sketches_merge_within_their_error(spark):
    df = spark.range(60_000).select(F.date_add(F.lit("2016-01-01").cast("date"), (F.col("id") % 360).cast("int")).alias("date"),
                                    (F.col("id") % 50).cast("int").alias("store_nbr"), (F.col("id") % 30_011).alias("item_nbr"))
    s = sample.key_sketches(sample.with_day(df).withColumn("month", F.month("date")))
    r = sample.merged_profile(s).first()
    assert r.rows == 60_000 and r.dates == 360 and r.stores == 50 and abs(r["items"] - 30_011) < 0.06 * 30_011
    two = sample.merged_profile(s.filter("month <= 2")).first()
    want = df.filter(F.month("date") <= 2).agg(F.count_distinct("item_nbr"), F.count_distinct("date")).first()
    assert abs(two["items"] - want[0]) < 0.06 * want[0] and two.dates == want[1]


@pytest.mark.parametrize("max_inline", [3, 10])
def test_grid_of_blocks_equals_inline_grid(spark, max_inline):
    facts = spark.createDataFrame([(f"2016-01-{1 + k % 28:02d}", k * 7 % 23, k * 5 % 41, float(k), bool(k % 2)) for k in range(300)],
                                  "date string, store_nbr int, item_nbr int, unit_sales double, onpromotion boolean")
    facts = facts.withColumn("date", F.col("date").cast("date")).dropDuplicates(["date", "store_nbr", "item_nbr"]).persist()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(G.grid(facts, max_inline=max_inline)) == rows(G.grid(facts))
    a, b = G.zero_fill(facts, max_inline=max_inline), G.zero_fill(facts)
    assert a.columns == b.columns and rows(a) == rows(b)
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
