"""Dimension joins and calendar features."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfcast.functions.calendar import date_features

SET_COLUMNS = ["date", "store_nbr", "item_nbr", "unit_sales", "onpromotion",
               "city", "state", "type", "cluster", "family", "class", "perishable",
               "month", "week_of_year", "day_of_week"]


def enrich_dims(panel: DataFrame, stores: DataFrame, items: DataFrame) -> DataFrame:
    """Inner joins to stores and items (rows without a dimension row vanish).

    Join strategy is left to the planner: the store table is tiny and is
    broadcast by size statistics; the item table is joined on item_nbr, which
    is also the grid's partitioning key, so at scale only the items move."""
    return panel.join(stores, "store_nbr", "inner").join(items, "item_nbr", "inner")


def build_set(panel: DataFrame, stores: DataFrame, items: DataFrame) -> DataFrame:
    """Panel + dimensions + month / ISO week / weekday, in the dataset column order."""
    return date_features(enrich_dims(panel, stores, items)).select(*SET_COLUMNS)
