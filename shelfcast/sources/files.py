"""File sources and sinks.

* CSV scans of the original sales / stores / items files, with explicit schemas
  (no inference pass over the data).
* The prepared dataset, stored as Parquet partitioned by month so a reader of
  one period prunes whole folders.
* The same dataset as a table bucketed by item within its months, so that per-item
  statistics and joins of two such tables need no exchange.
* Result tables: run metrics (appended), iteration history (one row per run,
  iteration and dataset; pivoted wide on write) and feature importance.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.schema import ITEMS, SALES, STORES

# The sales CSV has an id in column 0; the five used columns follow it.
_SALES_CSV = T.StructType([T.StructField("id", T.LongType(), True)] + [
    T.StructField(f.name, f.dataType, True) for f in SALES.fields])


CORRUPT = "_corrupt"


def read_checked_csv(spark: SparkSession, path: str, schema: T.StructType, required=()) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects) of a CSV with a header. A line that does not parse under
    ``schema`` (wrong number of fields, a value of the wrong type) or lacks a required
    value is a reject: file, reason, line. Every column is parsed whatever is selected
    later, so the split does not depend on the query."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    raw = (spark.read.schema(full).option("header", True).option("dateFormat", "yyyy-MM-dd").option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    names = [f.name for f in schema.fields]
    missing = F.lit(None).cast("string")
    for c in reversed(list(required)):
        missing = F.when(F.col(c).isNull(), F.lit(f"no {c}")).otherwise(missing)
    reason = F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed")).otherwise(missing)
    line = F.coalesce(F.col(CORRUPT), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]))
    marked = raw.withColumns({"_reason": reason, "_line": line, "_file": F.input_file_name()})
    marked = marked.filter(F.length("_line") >= 0)       # always true, but needs every column parsed
    good = marked.filter(F.col("_reason").isNull()).select(*names)
    return good, marked.filter(F.col("_reason").isNotNull()).select(
        F.col("_file").alias("file"), F.col("_reason").alias("reason"), F.col("_line").alias("line"))


def save_rejects(rejects: DataFrame, path: str) -> dict:
    """Write the rejects; number of lines by reason, observed in the same pass."""
    from pyspark.sql import Observation
    seen = Observation("rejects")
    all_ = F.count(F.lit(1)).alias("all")
    bad = F.count(F.when(F.col("reason") == "malformed", 1)).alias("malformed")
    rejects.observe(seen, all_, bad).write.mode("overwrite").parquet(path)
    return {k: int(v) for k, v in seen.get.items()}


def checked_sales(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sales rows and rejects; the key must be there, units and promotion may be missing."""
    good, rejects = read_checked_csv(spark, path, _SALES_CSV, ("date", "store_nbr", "item_nbr"))
    return good.select(*[f.name for f in SALES.fields]), rejects


def read_sales_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns 1-5 of the sales CSV (date, store_nbr, item_nbr, unit_sales,
    onpromotion); onpromotion stays nullable, date is a DATE. Lines that don't parse
    are left out (``checked_sales`` has them)."""
    return checked_sales(spark, path)[0]


def read_stores_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_checked_csv(spark, path, STORES, ("store_nbr",))[0]


def read_items_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_checked_csv(spark, path, ITEMS, ("item_nbr",))[0]


def dataset_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/train_{name}"


def save_dataset(df: DataFrame, root: str, name: str, partition_by: str | None = "month") -> str:
    path = dataset_path(root, name)
    w = df.write.mode("overwrite")
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return path


def load_dataset(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(dataset_path(root, name))


def save_bucketed(df: DataFrame, root: str, name: str, buckets: int, key: str = "item_nbr", partition_by: str = "month") -> DataFrame:
    """Save a dataset as a table of ``buckets`` buckets of ``key`` within each partition,
    at the dataset's path, and return it. One exchange puts every bucket into one task, so a
    month has one file a bucket. A hot key is one bucket: choose other buckets than the
    item where one item holds a large part of the rows (a zero-filled panel has none)."""
    path = dataset_path(root, name)
    (df.repartition(buckets, key).write.mode("overwrite").partitionBy(partition_by)
     .bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table_name(root, name)))
    return df.sparkSession.table(table_name(root, name))


def load_bucketed(spark: SparkSession, root: str, name: str, schema: T.StructType, buckets: int,
                  key: str = "item_nbr", partition_by: str = "month") -> DataFrame:
    """The table that ``save_bucketed`` left at the dataset's path, declared anew for a
    session whose catalog doesn't have it (the files carry their bucket numbers)."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    table = table_name(root, name)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({cols}) USING parquet PARTITIONED BY ({partition_by}) "
              f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{dataset_path(root, name)}'")
    spark.catalog.recoverPartitions(table)
    return spark.table(table)


def table_name(root: str, name: str) -> str:
    """Catalog name of a dataset; two folders' datasets of one name are two tables."""
    return "train_" + "".join(c if c.isalnum() else "_" for c in name) + f"_{zlib.crc32(dataset_path(root, name).encode()):08x}"


def append_metrics(df: DataFrame, path: str) -> None:
    """Add (run, metric, value) rows to a folder with one partition per run. A run's
    partition is staged and replaced as a whole, so a repeated job leaves one row per
    run and metric, and other runs stay."""
    (df.select("run", "metric", "value").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run").parquet(path))


def history_wide(history: DataFrame) -> DataFrame:
    """One row per (run, iteration), one rmse column per dataset."""
    datasets = sorted(r[0] for r in history.select("dataset").distinct().collect())
    return (history.groupBy("run", "iteration").pivot("dataset", datasets)
            .agg(F.first("rmse")).orderBy("run", "iteration"))


def save_history(history: DataFrame, path: str) -> None:
    history_wide(history).write.mode("overwrite").option("header", True).csv(path)


def save_importance(importance: DataFrame, path: str) -> None:
    importance.write.mode("overwrite").option("header", True).csv(path)
