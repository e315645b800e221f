"""End-to-end jobs on sf0.001: dataset files, metrics appends, history,
importance, models, CV tables, chart tables."""

from shelfcast.plans import jobs
from conftest import SF_SMALL


def test_jobs_end_to_end(spark, tmp_dir):
    out = tmp_dir
    c = jobs.job_prepare(spark, SF_SMALL, out)["counts"]
    train = spark.read.parquet(f"{out}/data/train_{jobs.TRAIN_NAME}")
    assert train.count() == c["date"] * c["store_nbr"] * c["item_nbr"]
    jobs.job_train_trees(spark, SF_SMALL, out, max_iter=2, max_depth=3, min_instances=5)
    jobs.job_train_trees(spark, SF_SMALL, out, per_day=True, max_iter=2, max_depth=3, min_instances=5)
    jobs.job_train_mlp(spark, SF_SMALL, out, layers=(8,), epochs=1, batch_size=256)
    m = spark.read.parquet(f"{out}/results/metrics")
    runs = {r.run for r in m.select("run").distinct().collect()}
    assert any(r.endswith("_day_all") for r in runs) and len(runs) == 1 + 8 + 1
    assert m.count() == 2 * len(runs)
    hist = spark.read.option("header", True).csv(f"{out}/results/history/*")
    assert {"run", "iteration", "training", "valid"} <= set(hist.columns)
    imp = spark.read.option("header", True).csv(f"{out}/results/importance/*")
    assert imp.count() > 0
    s = jobs.job_tune_trees(spark, SF_SMALL, out, rates=[0.1], leaf_mins=[5, 10], k=2, max_iter=2, max_depth=2)
    assert s.count() == 2
    s = jobs.job_tune_mlp(spark, SF_SMALL, out, layouts=[(4,)], k=2, epochs=1)
    assert s.collect()[0].n_folds == 2
    jobs.job_charts(spark, SF_SMALL, out)
    fam = spark.read.option("header", True).csv(f"{out}/results/charts/sum_sales_vs_family")
    assert fam.count() == train.select("family").distinct().count()
