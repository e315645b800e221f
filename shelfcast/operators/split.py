"""Reproducible train/validation split and k-fold assignment by key hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.keyhash import DEFAULT_SEED, fold_of, train_flag

# Text "item|date" of a row's key, where a frame carries it: made once an item and date
# instead of once a row, it hashes like the two columns.
ITEM_DATE = "_item_date"


def with_item_date(df: DataFrame) -> DataFrame:
    return df.withColumn(ITEM_DATE, F.concat_ws("|", "item_nbr", "date"))


def _key_columns(df: DataFrame) -> tuple:
    return ("store_nbr", ITEM_DATE) if ITEM_DATE in df.columns else ("store_nbr", "item_nbr", "date")


def with_split(df: DataFrame, test_size: float = 0.2, seed=DEFAULT_SEED) -> DataFrame:
    """Adds ``is_train`` (True for the 1 - test_size side)."""
    return df.withColumn("is_train", train_flag(seed, test_size, _key_columns(df))).drop(ITEM_DATE)


def hash_split(df: DataFrame, test_size: float = 0.2, seed=DEFAULT_SEED):
    flagged = with_split(df, test_size, seed)
    return (flagged.filter(F.col("is_train")).drop("is_train"),
            flagged.filter(~F.col("is_train")).drop("is_train"))


def assign_fold(df: DataFrame, k: int = 5, seed=DEFAULT_SEED) -> DataFrame:
    return df.withColumn("fold", fold_of(k, seed, _key_columns(df))).drop(ITEM_DATE)
