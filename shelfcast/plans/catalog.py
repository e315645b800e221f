"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Every query reads the whole star schema derived from the given tables. Values
that are doubles are rounded to 6 places and non-finite doubles are reported
as NULL plus a status string, so the DuckDB oracle (``plans.oracle``) can be
compared value by value.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.calendar import day_name
from shelfcast.functions.numeric import denormalise, round6
from shelfcast.operators import encode, evaluate, gbt, grid as G, mlp, report, sample, split, stats
from shelfcast.operators.enrich import enrich_dims
from shelfcast.plans import prepare
from shelfcast.schema import CATEGORICAL, KEY, UNUSED_COLUMNS
from shelfcast.sources import star

_DS_CACHE: dict = {}


def _app(spark: SparkSession) -> str:
    # part of the caches' keys: frames of a stopped application are not taken up again
    return spark.sparkContext.applicationId


def _ds(spark: SparkSession, sf_dir: str) -> prepare.Dataset:
    """The prepared dataset for this session and folder (built once: its key
    counts and key lists are small jobs that every grid query would repeat)."""
    k = (_app(spark), sf_dir)
    if k not in _DS_CACHE:
        _DS_CACHE[k] = prepare.load(spark, sf_dir)
    return _DS_CACHE[k]


def _dims(spark, sf_dir):
    return star.stores(spark, sf_dir), star.items(spark, sf_dir)


# ---------------------------------------------------------------- A: scans

def scan_sales(spark, sf_dir):
    return star.sales(spark, sf_dir)


def scan_stores(spark, sf_dir):
    return star.stores(spark, sf_dir)


def scan_items(spark, sf_dir):
    return star.items(spark, sf_dir)


# ---------------------------------------------------------------- B/C: sampling, grid

def sample_period(spark, sf_dir):
    return sample.sample_period(star.sales(spark, sf_dir), prepare.TRAIN_START, prepare.TRAIN_END)


def sample_perishable(spark, sf_dir):
    return sample.sample_perishable(star.sales(spark, sf_dir), star.items(spark, sf_dir),
                                    prepare.TRAIN_START, prepare.TRAIN_END)


def duplicate_keys(spark, sf_dir):
    return sample.duplicate_keys(star.sales_lines(spark, sf_dir))


def grid(spark, sf_dir):
    ds = _ds(spark, sf_dir)
    return G.grid(ds.facts, counts=ds.counts)


def zero_fill(spark, sf_dir):
    ds = _ds(spark, sf_dir)
    return prepare.train_panel(ds.facts, ds.counts)


def profile(spark, sf_dir):
    ds = _ds(spark, sf_dir)
    return (sample.profile(ds.facts, "sampled")
            .unionByName(sample.profile(prepare.train_panel(ds.facts, ds.counts), "zero_filled")))


def enrich(spark, sf_dir):
    ds = _ds(spark, sf_dir)
    st, it = _dims(spark, sf_dir)
    return enrich_dims(prepare.train_panel(ds.facts, ds.counts), st, it)


def date_features(spark, sf_dir):
    return _ds(spark, sf_dir).train


def fill_missing(spark, sf_dir):
    return _ds(spark, sf_dir).test.select(*KEY, "unit_sales", "onpromotion")


def head_tail(spark, sf_dir):
    return report.head_tail(_ds(spark, sf_dir).train.select(*KEY, "unit_sales", "onpromotion", "family"))


def calendar_names(spark, sf_dir):
    d = _ds(spark, sf_dir).train.select("date").distinct()
    return d.select("date", F.date_format("date", "MMMM").alias("month_name"),
                    F.date_format("date", "EEEE").alias("day_name"))


# ---------------------------------------------------------------- D: statistics, reports

def item_stats(spark, sf_dir):
    s = stats.item_stats(sample.fill_missing(_ds(spark, sf_dir).train))
    return s.select("item_nbr", round6(F.col("mean")).alias("mean"), round6(F.col("std")).alias("std"))


def item_stats_sparse(spark, sf_dir):
    st, it = _dims(spark, sf_dir)
    s = prepare.sparse_stats(_ds(spark, sf_dir), st, it)
    return s.select("item_nbr", round6(F.col("mean")).alias("mean"), round6(F.col("std")).alias("std"))


def sales_by_family(spark, sf_dir):
    ds = _ds(spark, sf_dir)
    st, it = _dims(spark, sf_dir)
    return report.sales_by_family_sparse(ds.facts, st, it, prepare.matched_stores(ds, st))


def _family_means(spark, sf_dir, by):
    # from the observed facts and the panel's row counts: equal to the mean over the grid
    ds = _ds(spark, sf_dir)
    st, it = _dims(spark, sf_dir)
    return report.mean_by_family_sparse(ds.facts, st, it, by, prepare.matched_stores(ds, st))


def month_by_family(spark, sf_dir):
    return _family_means(spark, sf_dir, "month")


def dow_by_family(spark, sf_dir):
    return _family_means(spark, sf_dir, "day_of_week")


def _family_pivot(spark, sf_dir, by):
    families = report.families_sparse(_ds(spark, sf_dir).facts, star.items(spark, sf_dir))
    return report.pivot_means(_family_means(spark, sf_dir, by), by, families)


def month_family_pivot(spark, sf_dir):
    return _family_pivot(spark, sf_dir, "month")


def dow_family_pivot(spark, sf_dir):
    return _family_pivot(spark, sf_dir, "day_of_week")


# ---------------------------------------------------------------- H3/C2: normalisation

_NORM_CACHE: dict = {}


def _normalised(spark, sf_dir):
    """Normalised train/test frames, once per session and folder. The test rows and the
    item statistics are persisted; the training rows are not: they are many times the facts,
    are grown from them without a join or an exchange of grid rows, and every query reads
    them once, in the columns it needs."""
    k = (_app(spark), sf_dir)
    if k not in _NORM_CACHE:
        ds = _ds(spark, sf_dir)
        st = prepare.sparse_stats(ds, ds.stores, ds.items).persist(StorageLevel.MEMORY_AND_DISK)
        tr, te, _ = prepare.normalised(ds, st)
        _NORM_CACHE[k] = (tr, te.persist(StorageLevel.MEMORY_AND_DISK), st)
    return _NORM_CACHE[k]


def _keyed_rows(spark, sf_dir) -> DataFrame:
    """The normalised training rows with the text of (item, date) that the splits hash."""
    return prepare.normalised(_ds(spark, sf_dir), _normalised(spark, sf_dir)[2], item_date=True)[0]


_CATEGORY_CACHE: dict = {}


def _category_rows(spark, sf_dir):
    # a row an item and a row a store: read once per column by the encoders
    k = (_app(spark), sf_dir)
    if k not in _CATEGORY_CACHE:
        rows = prepare.category_rows(_ds(spark, sf_dir), _normalised(spark, sf_dir)[2])
        _CATEGORY_CACHE[k] = rows.select(*CATEGORICAL).distinct().persist()
    return _CATEGORY_CACHE[k]


def normalise_train(spark, sf_dir):
    tr, _, _ = _normalised(spark, sf_dir)
    return stats.with_status(tr.select(*KEY, "unit_sales"))


def normalise_test(spark, sf_dir):
    _, te, _ = _normalised(spark, sf_dir)
    return stats.with_status(te.select(*KEY, "unit_sales"))


def unseen_items(spark, sf_dir):
    # the session's training statistics (same item set as the dense form)
    st = _normalised(spark, sf_dir)[2]
    return stats.unseen_items(_ds(spark, sf_dir).test, st).select(*KEY, "unit_sales")


# ---------------------------------------------------------------- I: encoding, splitting

def label_encode(spark, sf_dir):
    tr, te, _ = _normalised(spark, sf_dir)
    _, te_e, _ = encode.label_encode(tr, te, CATEGORICAL, as_int=True, fit_on=_category_rows(spark, sf_dir))
    return te_e.select(*KEY, *CATEGORICAL)


def one_hot(spark, sf_dir):
    te = _normalised(spark, sf_dir)[1]
    vocab = encode.fit_one_hot(_category_rows(spark, sf_dir), CATEGORICAL)
    return encode.one_hot(te.select(*KEY, *CATEGORICAL), vocab)


def feature_frame(spark, sf_dir):
    mf = _frames(spark, sf_dir, "tree")
    return stats.with_status(mf.train.select(
        *KEY, "unit_sales", F.col("onpromotion").cast("int").alias("onpromotion"),
        *[F.col(c).cast("int").alias(c) for c in CATEGORICAL], "month", "day_of_week", "is_train"))


def split_80_20(spark, sf_dir):
    return split.with_split(_ds(spark, sf_dir).train.select(*KEY))


def kfold_assign(spark, sf_dir):
    return split.assign_fold(_ds(spark, sf_dir).train.select(*KEY), 5)


def segment_day(spark, sf_dir):
    ds = _ds(spark, sf_dir)
    tr = split.with_split(ds.train.select(*KEY, "day_of_week"))
    a = tr.groupBy("day_of_week").agg(
        F.sum(F.col("is_train").cast("int")).cast("bigint").alias("train_rows"),
        F.sum((~F.col("is_train")).cast("int")).cast("bigint").alias("valid_rows"))
    b = ds.test.groupBy("day_of_week").agg(F.count(F.lit(1)).alias("test_rows"))
    return (a.join(b, "day_of_week", "full")
            .select("day_of_week", day_name(F.col("day_of_week")).alias("day_name"),
                    F.coalesce("train_rows", F.lit(0)).alias("train_rows"),
                    F.coalesce("valid_rows", F.lit(0)).alias("valid_rows"),
                    F.coalesce("test_rows", F.lit(0)).cast("bigint").alias("test_rows")))


# ---------------------------------------------------------------- D7-D10: evaluation with a
# non-learned predictor (training-split mean of the z-scored units per item and weekday)

def _baseline_scored(spark, sf_dir) -> DataFrame:
    te = _normalised(spark, sf_dir)[1]
    fit_rows = split.with_split(_keyed_rows(spark, sf_dir)).filter(F.col("is_train"))
    model = fit_rows.groupBy("item_nbr", "day_of_week").agg(F.avg("unit_sales").alias("prediction"))
    # merge: the plan takes the model for as small as the rows the grid is grown from
    return (te.join(model.hint("merge"), ["item_nbr", "day_of_week"], "left")
            .select(*KEY, "day_of_week", F.col("unit_sales").alias("y"),
                    F.coalesce("prediction", F.lit(0.0)).alias("prediction")))


def baseline_metrics(spark, sf_dir):
    return evaluate.metrics(_baseline_scored(spark, sf_dir), "baseline_item_weekday")


def metrics_rollup(spark, sf_dir):
    return evaluate.metrics_rollup(_baseline_scored(spark, sf_dir), "baseline_item_weekday")


def union_days(spark, sf_dir):
    # one model per weekday: the weekday is part of the models' key, so all seven are
    # fitted and scored in one pass, and their predictions are stacked as they come
    out = _baseline_scored(spark, sf_dir)
    return out.select(*KEY, "day_of_week", round6(F.col("y")).alias("y"),
                      round6(F.col("prediction")).alias("prediction"))


def denormalise_predictions(spark, sf_dir):
    _, te, st = _normalised(spark, sf_dir)
    scored = _baseline_scored(spark, sf_dir)
    ds = _ds(spark, sf_dir)
    units = ds.test.select(*KEY, F.col("unit_sales").alias("y_units"))
    return (scored.join(st, "item_nbr").join(units, KEY)
            .select(*KEY, F.round("y_units", 6).alias("y_units"),
                    round6(denormalise(F.col("prediction"), F.col("mean"), F.col("std"))).alias("prediction_units")))


def _settings() -> dict:
    """Part of the item's rows that a predictor's mean is taken over."""
    return {"item_mean": F.lit(-1), "item_weekday_mean": F.col("day_of_week")}


def _sums():
    """Rows, sum and sum of squares of the target."""
    y = F.col("unit_sales")
    return [F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("ss")]


def _up_to(month: int, value: str, where=None):
    """Sum of ``value`` over the months <= ``month``."""
    c = F.col("month") <= month
    return F.sum(F.when(c if where is None else c & where, F.col(value)).otherwise(F.lit(0.0)))


def _fold_errors(spark, sf_dir, months, k: int = 5) -> DataFrame:
    """setting, fold, iteration, rmse of two non-learned predictors (means per item, and per
    item and weekday): at iteration m a fold's predictor is fitted on the other folds' rows
    of months <= m and scored on all rows of the fold.

    The rows are read once, into (n, sum y, sum y^2) per (item, weekday, month, fold). The
    held-out prediction p of a (group, fold) is the mean of the group's other folds, and the
    fold's squared error is sum y^2 - 2 p sum y + n p^2 - no refit, and no join: a group's
    folds meet in one row with their running sums by month. All groups hold the item, by which
    the rows are dealt, so nothing is exchanged before the errors per (setting, fold, iteration)."""
    tr = _keyed_rows(spark, sf_dir)
    rows = split.assign_fold(tr.select(*KEY, "month", "day_of_week", "unit_sales", split.ITEM_DATE), k)
    sums = rows.groupBy("item_nbr", "day_of_week", "month", "fold").agg(*_sums())
    own = (sums.withColumn("g", F.explode(F.array(*[F.struct(F.lit(n).alias("setting"), c.cast("int").alias("part"))
                                                    for n, c in _settings().items()])))
           .groupBy("item_nbr", "g", "fold")
           .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
                *[_up_to(m, "n").alias(f"n{m}") for m in months], *[_up_to(m, "s").alias(f"s{m}") for m in months]))
    group = (own.select("item_nbr", "g", F.struct(
                "fold", "n", "s", "ss", F.array(*[f"n{m}" for m in months]).alias("n_own"),
                F.array(*[f"s{m}" for m in months]).alias("s_own")).alias("held"),
                *[f"n{m}" for m in months], *[f"s{m}" for m in months])
             .groupBy("item_nbr", "g")
             .agg(F.collect_list("held").alias("held"), F.array(*[F.sum(f"n{m}") for m in months]).alias("n_all"),
                  F.array(*[F.sum(f"s{m}") for m in months]).alias("s_all")))
    each = (group.select("g.setting", "n_all", "s_all", F.explode("held").alias("h"))
            .select("setting", "h.*", F.posexplode(F.arrays_zip("n_all", "s_all", "h.n_own", "h.s_own")).alias("at", "v")))
    n_fit = F.col("v.n_all") - F.col("v.n_own")
    p = F.when(n_fit > 0, (F.col("v.s_all") - F.col("v.s_own")) / n_fit).otherwise(F.lit(0.0))
    err = (each.withColumn("p", p)
           .select("setting", "fold", F.element_at(F.array(*map(F.lit, months)), F.col("at") + 1).alias("iteration"), "n",
                   (F.col("ss") - 2 * F.col("p") * F.col("s") + F.col("n") * F.col("p") * F.col("p")).alias("sse")))
    return (err.groupBy("setting", "fold", "iteration")
            .agg(F.sqrt(F.greatest(F.sum("sse"), F.lit(0.0)) / F.sum("n")).alias("rmse")))


def cv_summary(spark, sf_dir):
    """5-fold CV of two non-learned predictors: leave-one-fold-out means per
    item, and per item and weekday."""
    return evaluate.cv_summary(_fold_errors(spark, sf_dir, [12]))


def _month_curve(spark, sf_dir) -> DataFrame:
    """Learning curve of the non-learned predictor: at iteration m it is fitted
    on the training-split rows of months <= m and scored on every validation
    row.

    The rows are read once, into (n, sum y, sum y^2) per (item, weekday, month, side), and a
    group's running training sums and validation sums meet in one row; a validation group's
    squared error at prediction p is sum y^2 - 2 p sum y + n p^2. The groups hold the item,
    by which the rows are dealt: no join and no exchange before the errors per iteration."""
    tr = _keyed_rows(spark, sf_dir)
    rows = split.with_split(tr.select(*KEY, "month", "day_of_week", "unit_sales", split.ITEM_DATE))
    sums = rows.groupBy("item_nbr", "day_of_week", "month", "is_train").agg(*_sums())
    fit, held, months = F.col("is_train"), ~F.col("is_train"), range(1, 13)
    group = (sums.groupBy("item_nbr", "day_of_week")
             .agg(F.array(*[F.struct(F.lit(m).alias("iteration"), _up_to(m, "n", fit).alias("n_fit"),
                                     _up_to(m, "s", fit).alias("s_fit")) for m in months]).alias("fits"),
                  *[F.sum(F.when(held, F.col(c))).alias(c) for c in ("n", "s", "ss")])
             .filter(F.col("n") > 0).select("n", "s", "ss", F.explode("fits").alias("f")))
    p = F.when(F.col("f.n_fit") > 0, F.col("f.s_fit") / F.col("f.n_fit")).otherwise(F.lit(0.0))
    err = group.withColumn("p", p).select(
        "f.iteration", "n", (F.col("ss") - 2 * F.col("p") * F.col("s") + F.col("n") * F.col("p") * F.col("p")).alias("sse"))
    return (err.groupBy("iteration")
            .agg(F.sqrt(F.greatest(F.sum("sse"), F.lit(0.0)) / F.sum("n")).alias("rmse"))
            .select(F.lit("baseline_by_month").alias("run"), "iteration", F.lit("valid").alias("dataset"), "rmse"))


CURVE_PATIENCE = 3


def _fold_curves(spark, sf_dir) -> DataFrame:
    # some 100 rows, which the summaries read twice
    return _fold_errors(spark, sf_dir, list(range(1, 13))).persist()


def cv_curve(spark, sf_dir):
    """Fold-mean curve and population std per setting and iteration."""
    from shelfcast.plans import tune
    return tune.cv_curve(_fold_curves(spark, sf_dir)).select(
        "setting", "iteration", round6(F.col("rmse_mean")).alias("rmse_mean"), round6(F.col("rmse_std")).alias("rmse_std"))


def cv_best(spark, sf_dir):
    """Per setting the patience rule on the fold-mean curve, with mean and std at the best iteration."""
    from shelfcast.plans import tune
    return tune.tree_cv_summary(_fold_curves(spark, sf_dir), CURVE_PATIENCE)


def cv_curve_wide(spark, sf_dir):
    """The curves of the folds in the wide form of the history file: one column per fold."""
    from shelfcast.sources.files import history_wide as wide
    c = _fold_curves(spark, sf_dir)
    return wide(c.select(F.col("setting").alias("run"), "iteration", F.concat(F.lit("fold"), F.col("fold")).alias("dataset"),
                         round6(F.col("rmse")).alias("rmse")))


def learning_curve(spark, sf_dir):
    return _month_curve(spark, sf_dir).withColumn("rmse", round6(F.col("rmse")))


def early_stop(spark, sf_dir):
    return evaluate.early_stop(_month_curve(spark, sf_dir), CURVE_PATIENCE)


# ---------------------------------------------------------------- J: models
# Registered queries run the workload's own settings (gbt.DEFAULTS, mlp.DEFAULTS), the two
# searches too: up to 100 rounds and 25 epochs, under the patience rules.
DAY_EPOCHS = 10     # epochs of the weekday perceptrons, as in the workload

_FRAMES: dict = {}
_RUNS: dict = {}


def _frames(spark, sf_dir, kind: str):
    k = (_app(spark), sf_dir, kind)
    if k not in _FRAMES:
        make = prepare.encode_trees if kind == "tree" else prepare.encode_mlp
        # encoded frames are cheap projections of the normalised frames; they are not stored
        _FRAMES[k] = make(*_normalised(spark, sf_dir), fit_on=_category_rows(spark, sf_dir))
    return _FRAMES[k]


def _run(spark, sf_dir, what: str):
    from shelfcast.plans import train as T
    k = (_app(spark), sf_dir, what)
    if k not in _RUNS:
        if what == "gbt":
            _RUNS[k] = T.trees(_frames(spark, sf_dir, "tree"), "gbt", **gbt.DEFAULTS)
        elif what == "gbt_day":
            _RUNS[k] = T.trees_per_day(_frames(spark, sf_dir, "tree"), "gbt", **gbt.DEFAULTS)
        elif what == "mlp":
            _RUNS[k] = T.mlp_run(_frames(spark, sf_dir, "mlp"), "mlp_256_128", **mlp.DEFAULTS)
        elif what == "mlp_day":
            _RUNS[k] = T.mlp_per_day(_frames(spark, sf_dir, "mlp"), "mlp_256_128",
                                     **{**mlp.DEFAULTS, "epochs": DAY_EPOCHS})
    return _RUNS[k]


def gbt_forecast(spark, sf_dir):
    from shelfcast.plans.train import scored_report
    return scored_report(_run(spark, sf_dir, "gbt").scored)


def gbt_metrics(spark, sf_dir):
    return _run(spark, sf_dir, "gbt").metrics


def gbt_history(spark, sf_dir):
    h = _run(spark, sf_dir, "gbt").history
    return h.withColumn("rmse", F.round("rmse", 6))


def history_wide(spark, sf_dir):
    from shelfcast.sources.files import history_wide as wide
    return wide(_run(spark, sf_dir, "gbt").history)


def gbt_early_stop(spark, sf_dir):
    h = _run(spark, sf_dir, "gbt").history.filter(F.col("dataset") == "valid")
    return evaluate.early_stop(h, gbt.DEFAULTS["patience"])


def gbt_importance(spark, sf_dir):
    return _run(spark, sf_dir, "gbt").importance


def gbt_top_features(spark, sf_dir):
    from shelfcast.operators.gbt import top_features
    return top_features(_run(spark, sf_dir, "gbt").importance, 10)


def gbt_by_day(spark, sf_dir):
    return _run(spark, sf_dir, "gbt_day").metrics


def gbt_by_day_importance(spark, sf_dir):
    return _run(spark, sf_dir, "gbt_day").importance


def gbt_grid_cv(spark, sf_dir):
    from shelfcast.plans import tune
    p = {k: gbt.DEFAULTS[k] for k in ("max_iter", "max_depth", "patience")}     # rate and leaf size are searched
    return tune.tree_cv_summary(tune.tree_cv_curves(_frames(spark, sf_dir, "tree"), **p), p["patience"])


def mlp_forecast(spark, sf_dir):
    from shelfcast.plans.train import scored_report
    return scored_report(_run(spark, sf_dir, "mlp").scored)


def mlp_metrics(spark, sf_dir):
    return _run(spark, sf_dir, "mlp").metrics


def mlp_history(spark, sf_dir):
    return _run(spark, sf_dir, "mlp").history.withColumn("rmse", F.round("rmse", 6))


def mlp_by_day(spark, sf_dir):
    return _run(spark, sf_dir, "mlp_day").metrics


def mlp_layout_cv(spark, sf_dir):
    from shelfcast.plans import tune
    p = {k: v for k, v in mlp.DEFAULTS.items() if k != "layers"}     # the layers are searched
    rows = tune.mlp_layout_cv(_frames(spark, sf_dir, "mlp"), **p)
    return tune.mlp_cv_summary(rows)


def queries() -> dict:
    return {
        "scan_sales": scan_sales,
        "scan_stores": scan_stores,
        "scan_items": scan_items,
        "sample_period": sample_period,
        "sample_perishable": sample_perishable,
        "duplicate_keys": duplicate_keys,
        "grid": grid,
        "zero_fill": zero_fill,
        "profile": profile,
        "enrich_dims": enrich,
        "date_features": date_features,
        "fill_missing": fill_missing,
        "head_tail": head_tail,
        "calendar_names": calendar_names,
        "item_stats": item_stats,
        "item_stats_sparse": item_stats_sparse,
        "sales_by_family": sales_by_family,
        "month_by_family": month_by_family,
        "dow_by_family": dow_by_family,
        "month_family_pivot": month_family_pivot,
        "dow_family_pivot": dow_family_pivot,
        "normalise_train": normalise_train,
        "normalise_test": normalise_test,
        "unseen_items": unseen_items,
        "label_encode": label_encode,
        "one_hot": one_hot,
        "feature_frame": feature_frame,
        "split_80_20": split_80_20,
        "kfold_assign": kfold_assign,
        "segment_day": segment_day,
        "baseline_metrics": baseline_metrics,
        "metrics_rollup": metrics_rollup,
        "union_days": union_days,
        "denormalise": denormalise_predictions,
        "cv_summary": cv_summary,
        "learning_curve": learning_curve,
        "early_stop": early_stop,
        "cv_curve": cv_curve,
        "cv_best": cv_best,
        "cv_curve_wide": cv_curve_wide,
        "gbt_forecast": gbt_forecast,
        "gbt_metrics": gbt_metrics,
        "gbt_history": gbt_history,
        "history_wide": history_wide,
        "gbt_early_stop": gbt_early_stop,
        "gbt_importance": gbt_importance,
        "gbt_top_features": gbt_top_features,
        "gbt_by_day": gbt_by_day,
        "gbt_by_day_importance": gbt_by_day_importance,
        "gbt_grid_cv": gbt_grid_cv,
        "mlp_forecast": mlp_forecast,
        "mlp_metrics": mlp_metrics,
        "mlp_history": mlp_history,
        "mlp_by_day": mlp_by_day,
        "mlp_layout_cv": mlp_layout_cv,
    }
