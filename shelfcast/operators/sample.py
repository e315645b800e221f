"""Sampling of the sales fact: period, perishable segment, profiles, key checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.schema import KEY


def _as_date(v) -> dt.date:
    return v if isinstance(v, dt.date) else dt.date.fromisoformat(str(v))


def sample_period(sales: DataFrame, start, end) -> DataFrame:
    """Rows whose date lies in [start, end] (inclusive day range). On a DATE
    column this is a range predicate that reaches the Parquet scan."""
    return sales.filter(F.col("date").between(F.lit(_as_date(start)), F.lit(_as_date(end))))


def sample_perishable(sales: DataFrame, items: DataFrame, start, end) -> DataFrame:
    """Period rows of perishable items: a left-semi join to the item dimension,
    so the fact never widens and an item row can never duplicate a sale."""
    perishable = items.filter(F.col("perishable") == 1).select("item_nbr")
    return sample_period(sales, start, end).join(perishable, "item_nbr", "left_semi")


def fill_missing(df: DataFrame) -> DataFrame:
    """Unknown sales count as 0 units, unknown promotion as not on promotion."""
    return df.na.fill({"unit_sales": 0.0, "onpromotion": False})


def profile(df: DataFrame, label: str | None = None) -> DataFrame:
    """Row count and distinct dates / stores / items in one aggregation."""
    out = df.agg(F.count(F.lit(1)).alias("rows"),
                 F.count_distinct("date").alias("dates"),
                 F.count_distinct("store_nbr").alias("stores"),
                 F.count_distinct("item_nbr").alias("items"))
    if label is not None:
        out = out.select(F.lit(label).alias("stage"), "*")
    return out


SKETCH_LG_K = 12     # HyperLogLog sketches of 2^12 entries: a relative standard error of about 1.6 %


def key_sketches(df: DataFrame, by: str = "month") -> DataFrame:
    """Per value of ``by``: rows and a mergeable sketch of the distinct dates, stores and
    items, for profiles that are kept with the data and merged without reading it again."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"),
                              *[F.hll_sketch_agg(k, SKETCH_LG_K).alias(f"{k}_sketch") for k in ("day", "store_nbr", "item_nbr")])


def with_day(df: DataFrame) -> DataFrame:
    """``df`` with its date as a day number, which sketches can hold."""
    return df.withColumn("day", F.unix_date("date"))


def merged_profile(sketches: DataFrame, by: list | tuple = ()) -> DataFrame:
    """rows, dates, stores, items of the merged sketches, per ``by`` or in all."""
    est = [F.hll_sketch_estimate(F.hll_union_agg(f"{k}_sketch")).alias(n)
           for k, n in (("day", "dates"), ("store_nbr", "stores"), ("item_nbr", "items"))]
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), *est)


def duplicate_keys(df: DataFrame, key=KEY) -> DataFrame:
    """Keys that occur more than once (the panel requires a unique key)."""
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def assert_unique_key(df: DataFrame, key=KEY) -> None:
    """Fail like a re-index on a duplicated key would. One distributed job."""
    dup = duplicate_keys(df, key).limit(1).collect()
    if dup:
        raise ValueError(f"duplicate key {[dup[0][k] for k in key]} ({dup[0]['n']} rows)")
