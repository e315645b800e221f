"""Table schemas and the panel key.

Every table is a panel of daily sales series keyed by (date, store_nbr, item_nbr).
"""

from pyspark.sql import types as T

# Row key of the sales panel; unique in every fact-level table.
KEY = ["date", "store_nbr", "item_nbr"]
# Same key in the order the model frames are indexed by.
MODEL_KEY = ["store_nbr", "item_nbr", "date"]

SALES = T.StructType([
    T.StructField("date", T.DateType(), False),
    T.StructField("store_nbr", T.IntegerType(), False),
    T.StructField("item_nbr", T.LongType(), False),
    T.StructField("unit_sales", T.DoubleType(), True),
    T.StructField("onpromotion", T.BooleanType(), True),
])

STORES = T.StructType([
    T.StructField("store_nbr", T.IntegerType(), False),
    T.StructField("city", T.StringType(), True),
    T.StructField("state", T.StringType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("cluster", T.IntegerType(), True),
])

ITEMS = T.StructType([
    T.StructField("item_nbr", T.LongType(), False),
    T.StructField("family", T.StringType(), True),
    T.StructField("class", T.IntegerType(), True),
    T.StructField("perishable", T.IntegerType(), True),
])

ITEM_STATS = T.StructType([
    T.StructField("item_nbr", T.LongType(), False),
    T.StructField("mean", T.DoubleType(), True),
    T.StructField("std", T.DoubleType(), True),
])

METRICS = T.StructType([
    T.StructField("run", T.StringType(), False),
    T.StructField("metric", T.StringType(), False),
    T.StructField("value", T.DoubleType(), True),
])

HISTORY = T.StructType([
    T.StructField("run", T.StringType(), False),
    T.StructField("iteration", T.IntegerType(), False),
    T.StructField("dataset", T.StringType(), False),
    T.StructField("rmse", T.DoubleType(), True),
])

IMPORTANCE = T.StructType([
    T.StructField("run", T.StringType(), False),
    T.StructField("feature", T.StringType(), False),
    T.StructField("split", T.LongType(), False),
    T.StructField("gain", T.DoubleType(), True),
])

# Columns built by the dataset step but never used as model features.
UNUSED_COLUMNS = ["cluster", "city", "week_of_year", "class", "perishable"]
# Categorical model inputs.
CATEGORICAL = ["state", "type", "family"]
# Tree features, whole week (per-day models drop day_of_week).
TREE_FEATURES = ["onpromotion", "state", "type", "family", "month", "day_of_week"]
# MLP plain inputs, placed before the one-hot blocks.
MLP_PLAIN = ["onpromotion", "month", "day_of_week"]
TARGET = "unit_sales"
