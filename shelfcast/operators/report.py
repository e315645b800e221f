"""Summary tables behind the charts (sales by family, month, weekday) and
ordered previews. Aggregates only; the ordering is applied at the sink.

Sums and means exist in two equal forms: over the rows of a zero-filled panel, and
(``*_sparse``) over the observed facts with the panel's number of rows per group,
which is items of the family x dates of the group x stores: filled rows are 0, so
they count in the divisor only, and no grid row is generated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.calendar import date_features
from shelfcast.schema import KEY


def sales_by_family(df: DataFrame) -> DataFrame:
    """Total units per family (an all-missing family sums to 0, not NULL)."""
    return df.groupBy("family").agg(
        F.round(F.coalesce(F.sum("unit_sales"), F.lit(0.0)), 6).alias("unit_sales_sum"))


def mean_by_family(df: DataFrame, by: str) -> DataFrame:
    """Average units per (family, by) — long form of the line charts."""
    return df.groupBy("family", by).agg(F.round(F.avg("unit_sales"), 6).alias("unit_sales_mean"))


def pivot_by_family(df: DataFrame, by: str, families: list | None = None) -> DataFrame:
    """One row per ``by`` value, one column per family (the chart's wide form).
    Passing the family list avoids the extra distinct job of an open pivot."""
    g = df.groupBy(by)
    p = g.pivot("family", families) if families is not None else g.pivot("family")
    out = p.agg(F.avg("unit_sales"))
    return out.select(by, *[F.round(F.col(c), 6).alias(c) for c in out.columns if c != by])


def _panel_items(facts: DataFrame, items: DataFrame) -> DataFrame:
    """item_nbr, family of the panel's items."""
    return items.select("item_nbr", "family").join(facts.select("item_nbr"), "item_nbr", "left_semi")


def _panel_facts(facts: DataFrame, stores: DataFrame, items: DataFrame) -> DataFrame:
    return (facts.join(stores.select("store_nbr"), "store_nbr", "left_semi")
            .join(items.select("item_nbr", "family"), "item_nbr")
            .withColumn("_units", F.coalesce("unit_sales", F.lit(0.0))))


def families_sparse(facts: DataFrame, items: DataFrame) -> list:
    from shelfcast.operators.encode import vocabulary
    return vocabulary(_panel_items(facts, items), "family")


def sales_by_family_sparse(facts: DataFrame, stores: DataFrame, items: DataFrame, n_stores: int) -> DataFrame:
    """``sales_by_family`` of the panel of ``facts``: families sold only where no
    store row matches keep their row, with 0; without any such store the panel is empty."""
    sums = _panel_facts(facts, stores, items).groupBy("family").agg(F.sum("_units").alias("_s"))
    return (_panel_items(facts, items).select("family").distinct().alias("a")
            .join(sums.alias("b"), F.col("a.family").eqNullSafe(F.col("b.family")), "left").filter(F.lit(n_stores > 0))
            .select("a.family", F.round(F.coalesce("_s", F.lit(0.0)), 6).alias("unit_sales_sum")))


def mean_by_family_sparse(facts: DataFrame, stores: DataFrame, items: DataFrame, by: str, n_stores: int) -> DataFrame:
    """``mean_by_family`` of the panel of ``facts``; ``by`` is a calendar column
    (month, week_of_year, day_of_week), ``n_stores`` the panel's stores with a store row."""
    days = date_features(facts.select("date").distinct()).groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()
    if not n_stores or not days:         # an empty panel
        return facts.sparkSession.createDataFrame([], f"family string, {by} int, unit_sales_mean double")
    # at most 53 groups of dates
    groups = F.array(*[F.struct(F.lit(r[by]).cast("int").alias("g"), F.lit(r.n).cast("long").alias("n")) for r in sorted(days)])
    cells = (_panel_items(facts, items).groupBy("family").agg(F.count(F.lit(1)).alias("_items"))
             .select("family", "_items", F.explode(groups).alias("_d"))
             .select("family", F.col("_d.g").alias(by), (F.col("_items") * F.col("_d.n") * F.lit(n_stores)).alias("_cells")))
    sums = date_features(_panel_facts(facts, stores, items)).groupBy("family", by).agg(F.sum("_units").alias("_s"))
    a, b = cells.alias("a"), sums.alias("b")
    return (a.join(b, F.col("a.family").eqNullSafe(F.col("b.family")) & (F.col(f"a.{by}") == F.col(f"b.{by}")), "left")
            .select("a.family", f"a.{by}", F.round(F.coalesce("_s", F.lit(0.0)) / F.col("_cells"), 6).alias("unit_sales_mean")))


def pivot_means(means: DataFrame, by: str, families: list) -> DataFrame:
    """The wide form of ``mean_by_family``'s long one."""
    return means.groupBy(by).pivot("family", families).agg(F.first("unit_sales_mean"))


def head_rows(df: DataFrame, n: int = 5, order=KEY) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail_rows(df: DataFrame, n: int = 10, order=KEY) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def head_tail(df: DataFrame, n_head: int = 5, n_tail: int = 10, order=KEY) -> DataFrame:
    """First and last rows in key order (a top-k each side: TakeOrderedAndProject)."""
    return (head_rows(df, n_head, order).withColumn("part", F.lit("head"))
            .unionByName(tail_rows(df, n_tail, order).withColumn("part", F.lit("tail"))))
