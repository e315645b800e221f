"""Command-line jobs, one per step of the workload, reading and writing files.

    python -m shelfcast.plans.jobs prepare       --sf-dir DIR --out OUT
    python -m shelfcast.plans.jobs prepare       --sales-csv F --stores-csv F --items-csv F --out OUT
    python -m shelfcast.plans.jobs train-trees   --sf-dir DIR --out OUT [--per-day]
    python -m shelfcast.plans.jobs train-mlp     --sf-dir DIR --out OUT [--per-day]
    python -m shelfcast.plans.jobs tune-trees    --sf-dir DIR --out OUT
    python -m shelfcast.plans.jobs tune-mlp      --sf-dir DIR --out OUT
    python -m shelfcast.plans.jobs charts        --sf-dir DIR --out OUT

Outputs under OUT: ``data/train_<name>`` (Parquet by month), ``results/metrics``
(appended run/metric/value rows), ``results/history/<run>`` (CSV, one column per
dataset), ``results/importance/<run>`` (CSV), ``results/cv/<search>``,
``results/charts/<table>``, ``models/<run>``. Settings default to the workload's
own (``gbt.DEFAULTS``, ``mlp.DEFAULTS``); every one can be overridden.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators import boost, evaluate, gbt, mlp, report
from shelfcast.plans import prepare, train, tune
from shelfcast.session import build_session, checkpoint_dir
from shelfcast.sources import files

TRAIN_NAME = "perishable_zerofilled"
TEST_NAME = "perishable_test"


def job_prepare(spark, sf_dir: str | None, out: str, sales_csv: str | None = None, stores_csv: str | None = None,
                items_csv: str | None = None, buckets: int | None = None, **periods) -> dict:
    """Prepare and save the training and test sets, from the star schema of ``sf_dir`` or
    from CSV files (lines that don't parse go to ``results/rejects``). With ``buckets`` the
    training set is bucketed by item, and training jobs given the same number read the
    item statistics and join them without an exchange.

    The key check is part of the write: the zero-filled set has as many rows as the
    grid, which is known, unless a key of the facts is repeated; the rows are observed
    while they are written. A repeated key is an error, and nothing is published then
    but the rejects. Sketches of the distinct keys per month are saved with the data."""
    from pyspark.sql import Observation
    rejected = None
    if sales_csv:
        sales, rejects = files.checked_sales(spark, sales_csv)
        rejected = files.save_rejects(rejects, f"{out}/results/rejects")
        stores, items = files.read_stores_csv(spark, stores_csv), files.read_items_csv(spark, items_csv)
        files.save_dataset(stores, f"{out}/data", "stores", None)
        files.save_dataset(items, f"{out}/data", "items", None)
        ds = prepare.build_dataset(sales, stores, items, **periods)
    else:
        ds = prepare.load(spark, sf_dir, **periods)
    seen = Observation("train")
    panel = prepare.sample.with_day(prepare.train_panel(ds.facts, ds.counts)).withColumn("month", F.month("date"))
    sketches = prepare.sample.key_sketches(panel.observe(seen, F.count(F.lit(1)).alias("rows")))
    sketches.write.mode("overwrite").parquet(f"{out}/results/sketches")
    grid_rows = ds.counts["date"] * ds.counts["store_nbr"] * ds.counts["item_nbr"]
    rows = int(seen.get["rows"])
    if rows != grid_rows:
        raise ValueError(f"repeated keys: {rows} rows on a grid of {grid_rows}")
    if buckets:
        files.save_bucketed(ds.train, f"{out}/data", TRAIN_NAME, buckets)
    else:
        files.save_dataset(ds.train, f"{out}/data", TRAIN_NAME)
    files.save_dataset(ds.test, f"{out}/data", TEST_NAME)
    prof = prepare.sample.profile(ds.facts, "sampled").unionByName(
        prepare.sample.profile(files.load_dataset(spark, f"{out}/data", TRAIN_NAME), "zero_filled"))
    prof.write.mode("overwrite").option("header", True).csv(f"{out}/results/profile")
    return {"counts": ds.counts, "rejected": rejected}


def _saved_dataset(spark, sf_dir: str, out: str, buckets: int | None = None) -> prepare.Dataset:
    """The prepared dataset from the ``prepare`` job's files (dimensions from sf_dir, or
    without one from the copies that ``prepare`` made of the CSV files)."""
    from shelfcast.sources import star
    saved = files.load_dataset(spark, f"{out}/data", TRAIN_NAME)
    if buckets:
        saved = files.load_bucketed(spark, f"{out}/data", TRAIN_NAME, saved.schema, buckets)
    if not sf_dir:
        return prepare.Dataset(saved, files.load_dataset(spark, f"{out}/data", TEST_NAME),
                               facts=None, counts={}, stores=files.load_dataset(spark, f"{out}/data", "stores"),
                               items=files.load_dataset(spark, f"{out}/data", "items"))
    ds = prepare.Dataset(saved, files.load_dataset(spark, f"{out}/data", TEST_NAME),
                         facts=None, counts={}, stores=star.stores(spark, sf_dir), items=star.items(spark, sf_dir))
    return ds


def _write_run(res: train.RunResult, out: str, per_day: bool) -> None:
    if per_day:
        long = res.metrics.select(
            F.when(F.col("segment") == "all", F.concat(F.lit(res.run + "_day_"), F.lit("all")))
             .otherwise(F.concat(F.lit(res.run + "_day_"), F.col("segment"))).alias("run"),
            F.explode(F.array(F.struct(F.lit("rmse").alias("metric"), F.col("rmse").alias("value")),
                              F.struct(F.lit("mape").alias("metric"), F.col("mape").alias("value")))).alias("m")
        ).select("run", "m.metric", "m.value")
    else:
        long = evaluate.metrics_long(res.scored, res.run)
    files.append_metrics(long, f"{out}/results/metrics")
    files.save_history(res.history, f"{out}/results/history/{res.run}")
    if res.importance is not None:
        files.save_importance(res.importance, f"{out}/results/importance/{res.run}")


def job_train_trees(spark, sf_dir: str, out: str, per_day: bool = False, buckets: int | None = None, **params) -> train.RunResult:
    # statistics from the saved training set (dense form: no facts table at hand)
    ds = _saved_dataset(spark, sf_dir, out, buckets)
    st = prepare.stats.item_stats(prepare.sample.fill_missing(ds.train))
    mf = prepare.tree_frames(ds, item_stats=st)
    mf.train, mf.test = mf.train.persist(), mf.test.persist()
    p = {**{k: v for k, v in gbt.DEFAULTS.items()}, **params}
    run = train.run_name(TRAIN_NAME, "gbt", lr=p["step_size"], depth=p["max_depth"])
    res = train.trees_per_day(mf, run, **p) if per_day else train.trees(mf, run, **p)
    _write_run(res, out, per_day)
    boost.save(res.fits if per_day else {-1: res.fits}, f"{out}/models/{run}{'_per_day' if per_day else ''}")
    return res


def job_train_mlp(spark, sf_dir: str, out: str, per_day: bool = False, buckets: int | None = None, **params) -> train.RunResult:
    ds = _saved_dataset(spark, sf_dir, out, buckets)
    st = prepare.stats.item_stats(prepare.sample.fill_missing(ds.train))
    mf = prepare.mlp_frames(ds, item_stats=st)
    mf.train, mf.test = mf.train.persist(), mf.test.persist()
    p = {**mlp.DEFAULTS, **params}
    run = train.run_name(TRAIN_NAME, "mlp", layers="_".join(map(str, p["layers"])))
    res = train.mlp_per_day(mf, run, **p) if per_day else train.mlp_run(mf, run, **p)
    _write_run(res, out, per_day)
    if per_day:
        mlp.save_segments(res.fits, f"{out}/models/{run}_per_day")
    else:
        mlp.save(res.fits, f"{out}/models/{run}")
    return res


def job_tune_trees(spark, sf_dir: str, out: str, **params) -> DataFrame:
    ds = _saved_dataset(spark, sf_dir, out)
    st = prepare.stats.item_stats(prepare.sample.fill_missing(ds.train))
    mf = prepare.tree_frames(ds, item_stats=st)
    mf.train = mf.train.persist()
    patience = params.pop("patience", gbt.DEFAULTS["patience"])
    curves = tune.tree_cv_curves(mf, patience=patience, **params).persist()
    tune.cv_curve(curves).write.mode("overwrite").option("header", True).csv(f"{out}/results/cv/trees_curve")
    summary = tune.tree_cv_summary(curves, patience)
    summary.write.mode("overwrite").option("header", True).csv(f"{out}/results/cv/trees")
    return summary


def job_tune_mlp(spark, sf_dir: str, out: str, **params) -> DataFrame:
    ds = _saved_dataset(spark, sf_dir, out)
    st = prepare.stats.item_stats(prepare.sample.fill_missing(ds.train))
    mf = prepare.mlp_frames(ds, item_stats=st)
    mf.train = mf.train.persist()
    rows = tune.mlp_layout_cv(mf, **params).persist()
    rows.write.mode("overwrite").option("header", True).csv(f"{out}/results/cv/mlp_folds")
    summary = tune.mlp_cv_summary(rows)
    summary.write.mode("overwrite").option("header", True).csv(f"{out}/results/cv/mlp")
    return summary


def job_charts(spark, sf_dir: str, out: str) -> None:
    tr = files.load_dataset(spark, f"{out}/data", TRAIN_NAME)
    tables = {"sum_sales_vs_family": report.sales_by_family(tr).orderBy("family"),
              "month_vs_family": report.pivot_by_family(tr, "month").orderBy("month"),
              "day_of_week_vs_family": report.pivot_by_family(tr, "day_of_week").orderBy("day_of_week")}
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/results/charts/{name}")


def main(argv=None):
    ap = argparse.ArgumentParser(prog="shelfcast.plans.jobs")
    ap.add_argument("job", choices=["prepare", "train-trees", "train-mlp", "tune-trees", "tune-mlp", "charts"])
    ap.add_argument("--sf-dir")
    ap.add_argument("--sales-csv")
    ap.add_argument("--stores-csv")
    ap.add_argument("--items-csv")
    ap.add_argument("--train-period", nargs=2, metavar=("FROM", "TO"))
    ap.add_argument("--test-period", nargs=2, metavar=("FROM", "TO"))
    ap.add_argument("--out", required=True)
    ap.add_argument("--per-day", action="store_true")
    ap.add_argument("--buckets", type=int, help="prepare, train-trees, train-mlp: the training set is bucketed by item")
    ap.add_argument("--master", default=None)
    ap.add_argument("--max-iter", type=int)
    ap.add_argument("--max-depth", type=int)
    ap.add_argument("--epochs", type=int)
    a = ap.parse_args(argv)
    spark = build_session(a.master)
    checkpoint_dir(spark)
    extra = {k: v for k, v in {"max_iter": a.max_iter, "max_depth": a.max_depth}.items() if v is not None}
    if a.job == "prepare":
        periods = {k: tuple(v) for k, v in {"train_period": a.train_period, "test_period": a.test_period}.items() if v}
        print(job_prepare(spark, a.sf_dir, a.out, a.sales_csv, a.stores_csv, a.items_csv, a.buckets, **periods))
    elif a.job == "train-trees":
        job_train_trees(spark, a.sf_dir, a.out, a.per_day, a.buckets, **extra)
    elif a.job == "train-mlp":
        job_train_mlp(spark, a.sf_dir, a.out, a.per_day, a.buckets, **({"epochs": a.epochs} if a.epochs else {}))
    elif a.job == "tune-trees":
        job_tune_trees(spark, a.sf_dir, a.out, **extra)
    elif a.job == "tune-mlp":
        job_tune_mlp(spark, a.sf_dir, a.out, **({"epochs": a.epochs} if a.epochs else {}))
    elif a.job == "charts":
        job_charts(spark, a.sf_dir, a.out)


if __name__ == "__main__":
    main()
