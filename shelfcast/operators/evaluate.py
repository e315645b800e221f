"""Evaluation: error metrics per run and per segment, CV summaries, patience.

A scored frame has one row per predicted key: ..., day_of_week, y, prediction.
Everything here is an aggregation over it (partial aggregation before the
shuffle, one pass for all metrics), never a collect of predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.calendar import day_name
from shelfcast.functions.metrics import mape_agg, rmse_agg
from shelfcast.functions.numeric import ieee_status, round6


def _finite(c):
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def metric_columns(y="y", p="prediction"):
    """Aggregates shared by every metric report: row count, rows with a zero
    target (their MAPE term is infinite), rows excluded from RMSE because y or
    the prediction is not finite (squared error is undefined there), RMSE, MAPE."""
    yc, pc = F.col(y), F.col(p)
    ok = _finite(yc) & _finite(pc)
    return [F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.when(yc == 0, 1).otherwise(0)).cast("bigint").alias("n_zero_target"),
            F.sum(F.when(ok, 0).otherwise(1)).cast("bigint").alias("n_non_finite"),
            rmse_agg(F.when(ok, yc), F.when(ok, pc)).alias("rmse"),
            mape_agg(F.when(ok, yc), F.when(ok, pc)).alias("mape")]


def _report(df: DataFrame) -> DataFrame:
    return df.withColumns({"mape_status": ieee_status(F.col("mape")),
                           "rmse": round6(F.col("rmse")), "mape": round6(F.col("mape"))})


def metrics(scored: DataFrame, run: str, y="y", p="prediction") -> DataFrame:
    """run, n_rows, n_zero_target, n_non_finite, rmse, mape, mape_status."""
    return _report(scored.agg(*metric_columns(y, p)).select(F.lit(run).alias("run"), "*"))


def metrics_long(scored: DataFrame, run: str, y="y", p="prediction") -> DataFrame:
    """(run, metric, value) rows, the form the result files accumulate."""
    m = scored.agg(*metric_columns(y, p))
    return m.select(F.lit(run).alias("run"),
                    F.explode(F.array(
                        F.struct(F.lit("rmse").alias("metric"), F.col("rmse").alias("value")),
                        F.struct(F.lit("mape").alias("metric"), F.col("mape").alias("value")))).alias("m")
                    ).select("run", "m.metric", "m.value")


def metrics_rollup(scored: DataFrame, run: str, segment: str = "day_of_week",
                   y="y", p="prediction") -> DataFrame:
    """Metrics per segment and pooled over all rows in one aggregation
    (pooled RMSE is not the mean of the per-segment RMSEs)."""
    out = (scored.rollup(segment).agg(*metric_columns(y, p), F.grouping(segment).alias("_g")))
    name = day_name(F.col(segment)) if segment == "day_of_week" else F.col(segment).cast("string")
    return _report(out.select(
        F.lit(run).alias("run"),
        # the pooled row carries -1, not NULL, so the key column stays non-null
        F.when(F.col("_g") == 1, F.lit(-1)).otherwise(F.col(segment)).alias(segment),
        F.when(F.col("_g") == 1, F.lit("all")).otherwise(name).alias("segment"),
        "n_rows", "n_zero_target", "n_non_finite", "rmse", "mape"))


def cv_summary(fold_scores: DataFrame, setting: str = "setting", value: str = "rmse") -> DataFrame:
    """Per setting: folds, mean and population std of the fold scores."""
    return (fold_scores.groupBy(setting)
            .agg(F.count(F.lit(1)).alias("n_folds"),
                 F.round(F.avg(value), 6).alias(f"{value}_mean"),
                 F.round(F.stddev_pop(value), 6).alias(f"{value}_std")))


def patience_curve(history: DataFrame, patience: int, run: str = "run",
                   iteration: str = "iteration", value: str = "rmse") -> DataFrame:
    """Per row: the best iteration so far (first strict minimum; ties keep the
    earlier iteration) and whether the patience rule stops here."""
    w = Window.partitionBy(run).orderBy(iteration).rowsBetween(Window.unboundedPreceding, 0)
    best = F.min(F.struct(F.col(value).alias("v"), F.col(iteration).alias("i"))).over(w)
    return (history.withColumn("_best", best)
            .withColumn("best_iteration", F.col("_best.i"))
            .withColumn("stops", (F.col(iteration) - F.col("best_iteration")) >= patience)
            .drop("_best"))


def early_stop(history: DataFrame, patience: int, run: str = "run",
               iteration: str = "iteration", value: str = "rmse") -> DataFrame:
    """run, stop_iteration, best_iteration, best_rmse, n_iterations.

    Stop = first iteration that has gone ``patience`` iterations without a
    strict improvement (the last iteration if that never happens). One window
    pass: the running minimum of (value, iteration) carries both the best
    iteration and its value, so no self-join re-reads the history."""
    w = Window.partitionBy(run).orderBy(iteration).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(run)
    best = F.min(F.struct(F.col(value).alias("v"), F.col(iteration).alias("i"))).over(w)
    c = (history.withColumn("_best", best)
         .withColumn("_stops", (F.col(iteration) - F.col("_best.i")) >= patience))
    c = (c.withColumn("stop_iteration",
                      F.coalesce(F.min(F.when(F.col("_stops"), F.col(iteration))).over(whole),
                                 F.max(iteration).over(whole)))
         .withColumn("n_iterations", F.count(F.lit(1)).over(whole)))
    return (c.filter(F.col(iteration) == F.col("stop_iteration"))
            .select(run, "stop_iteration", F.col("_best.i").alias("best_iteration"),
                    F.round(F.col("_best.v"), 6).alias(f"best_{value}"), "n_iterations"))
