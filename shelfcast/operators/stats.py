"""Per-item sales statistics and the z-score normalisation that uses them.

Two equivalent forms of the statistics over a zero-filled panel:

* dense  — mean and sample std over the panel rows (aggregates the grid; with
  the grid partitioned by item this is a shuffle-free aggregation);
* sparse — the same numbers from the observed facts alone. Every filled row is
  0, so with N = dates x stores panel rows per item and k observed rows of mean
  m and squared-deviation sum M2, the panel has mean m*k/N and squared-deviation
  sum M2 + m^2*k*(N-k)/N (pairwise merge with a block of N-k zeros, Chan,
  Golub & LeVeque 1979). No grid rows are read or shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.numeric import ieee_status, round6, zscore


def item_stats(train: DataFrame, col: str = "unit_sales") -> DataFrame:
    """item_nbr, mean, std (sample std; NULL for a single row) over the rows given."""
    return (train.filter(F.col("item_nbr").isNotNull())
            .groupBy("item_nbr")
            .agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std")))


def item_stats_sparse(facts: DataFrame, rows_per_item: int, col: str = "unit_sales") -> DataFrame:
    """Statistics of the zero-filled panel from its non-zero-filled facts.

    ``facts`` must hold only rows that survive into the panel (dates, stores and
    items of the grid with a dimension row); ``rows_per_item`` is the panel's
    dates x stores. Missing units count as 0, like the fill does."""
    n = F.lit(float(rows_per_item))
    x = F.coalesce(F.col(col), F.lit(0.0))
    agg = facts.groupBy("item_nbr").agg(F.count(F.lit(1)).cast("double").alias("k"),
                                         F.avg(x).alias("m"),
                                         F.var_pop(x).alias("vp"))
    m2 = F.col("vp") * F.col("k") + F.pow(F.col("m"), 2) * F.col("k") * (n - F.col("k")) / n
    return agg.select(
        "item_nbr",
        (F.col("m") * F.col("k") / n).alias("mean"),
        (F.when(n > 1, F.sqrt(F.greatest(m2, F.lit(0.0)) / (n - 1)))).alias("std"))


def normalise(df: DataFrame, stats: DataFrame, col: str = "unit_sales") -> DataFrame:
    """z-score ``col`` per item with the given statistics (inner join: rows of
    items without statistics are dropped, as the training-year fit implies)."""
    return standardise(df.join(stats, "item_nbr", "inner"), col)


def standardise(df: DataFrame, col: str = "unit_sales") -> DataFrame:
    """z-score ``col`` by the row's own ``mean`` and ``std``, which are dropped."""
    return df.withColumn(col, zscore(F.col(col), F.col("mean"), F.col("std"))).drop("mean", "std")


def unseen_items(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Rows the normalisation drops: items with no training statistics."""
    return df.join(stats.select("item_nbr"), "item_nbr", "left_anti")


def with_status(df: DataFrame, col: str = "unit_sales") -> DataFrame:
    """Report form: non-finite values become NULL plus a status string."""
    return df.withColumns({f"{col}_status": ieee_status(F.col(col)), col: round6(F.col(col))})
