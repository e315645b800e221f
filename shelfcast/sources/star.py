"""Star schema of the sales panel, derived from the driver's TPC-H-like tables.

The workload reads a sales fact (date, store, item, units, promotion) and two
dimensions. The test tables carry the same shape under other names; the mapping
below is fixed so that every engine derives identical tables from them:

  stores : one store per nation  -> store_nbr, city, state (region), type, cluster
  items  : one item per part     -> item_nbr, family (p_type), class, perishable
  sales  : lineitem by (ship day, supplier nation, part), summed quantity;
           promotion = discount >= 0.08, unknown when the line has no tax.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the derivation (must be the same in the SQL oracle):
#   store type     = letter 'A' + floor(n_nationkey / 5)
#   store cluster  = n_nationkey % 17 + 1
#   item class     = integer after the 6-character prefix 'Brand#' of p_brand
#   perishable     = p_size <= 2
#   onpromotion    = NULL when max(l_tax) = 0, else max(l_discount) >= 0.08
PROMO_DISCOUNT = 0.08
PERISHABLE_MAX_SIZE = 2
CLUSTER_MOD = 17


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation")
    r = _t(spark, sf_dir, "region")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("n_nationkey").cast("int").alias("store_nbr"),
                    F.col("n_name").alias("city"),
                    F.col("r_name").alias("state"),
                    F.chr(F.lit(65) + F.floor(F.col("n_nationkey") / 5).cast("int")).alias("type"),
                    (F.col("n_nationkey") % CLUSTER_MOD + 1).cast("int").alias("cluster")))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("bigint").alias("item_nbr"),
                    F.col("p_type").alias("family"),
                    F.substring("p_brand", 7, 1 << 20).cast("int").alias("class"),
                    F.when(F.col("p_size") <= PERISHABLE_MAX_SIZE, 1).otherwise(0).alias("perishable"))


def sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw fact lines keyed by (date, store_nbr, item_nbr); the key repeats."""
    li = _t(spark, sf_dir, "lineitem")
    su = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (li.join(su, li.l_suppkey == su.s_suppkey)
            .select(F.to_date("l_shipdate").alias("date"),
                    F.col("s_nationkey").cast("int").alias("store_nbr"),
                    F.col("l_partkey").cast("bigint").alias("item_nbr"),
                    F.col("l_quantity").alias("quantity"),
                    F.col("l_discount").alias("discount"),
                    F.col("l_tax").alias("tax")))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sales fact, one row per (date, store_nbr, item_nbr).

    A hash aggregate with map-side partial sums: a hot key costs one row per
    map task in the shuffle, not one row per line."""
    return (sales_lines(spark, sf_dir)
            .groupBy("date", "store_nbr", "item_nbr")
            .agg(F.sum("quantity").alias("unit_sales"),
                 F.when(F.max("tax") == 0, F.lit(None).cast("boolean"))
                  .otherwise(F.max("discount") >= PROMO_DISCOUNT).alias("onpromotion")))


def load_star(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return sales(spark, sf_dir), stores(spark, sf_dir), items(spark, sf_dir)
