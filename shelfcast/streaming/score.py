"""Score arriving sales files with a fitted tree model.

Every micro-batch runs the test-set preparation of ``plans.prepare`` (fill,
dimension joins, calendar, per-item z-score with training statistics, label
codes) and ``gbt.score``. The joins are stream-static joins against the small
dimension and statistics tables; there is no state across batches, so no
watermark is needed. Progress and output commits live under the shared
checkpoint folder, so a restarted query resumes without duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators import encode, gbt, sample, stats
from shelfcast.operators.enrich import build_set
from shelfcast.schema import CATEGORICAL, SALES, UNUSED_COLUMNS
from shelfcast.session import checkpoint_dir


def prepare_rows(sales: DataFrame, stores: DataFrame, items: DataFrame, item_stats: DataFrame,
                 label_encoder) -> DataFrame:
    """Test-set preparation of sales rows (batch or streaming)."""
    rows = build_set(sample.fill_missing(sales), stores, items)
    rows = stats.normalise(rows, item_stats).drop(*UNUSED_COLUMNS)
    rows = encode.apply_label_encoder(label_encoder, rows, CATEGORICAL)
    return rows.withColumn("onpromotion", F.col("onpromotion").cast("double"))


def scoring_stream(spark: SparkSession, source_dir: str, stores: DataFrame, items: DataFrame,
                   item_stats: DataFrame, label_encoder, fitted: gbt.TreeFit,
                   file_format: str = "parquet") -> DataFrame:
    """Streaming DataFrame of scored rows (key, day_of_week, y, prediction)."""
    stream = spark.readStream.schema(SALES).format(file_format).load(source_dir)
    return gbt.score(fitted, prepare_rows(stream, stores, items, item_stats, label_encoder))


def start_scoring(scored: DataFrame, sink_dir: str, name: str, available_now: bool = True):
    """Append scored rows as Parquet; checkpoint under spark.checkpoint.dir."""
    ckpt = f"{checkpoint_dir(scored.sparkSession).rstrip('/')}/streams/{name}"
    w = (scored.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", ckpt).outputMode("append").queryName(name))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
