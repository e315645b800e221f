"""Scans and sinks: the star schema (sales fact, stores, items) and result tables."""

from shelfcast.sources.star import items, sales, sales_lines, stores, load_star
from shelfcast.sources.files import (
    append_metrics, load_dataset, read_items_csv, read_sales_csv, read_stores_csv,
    save_dataset, save_history, save_importance,
)

__all__ = [
    "items", "sales", "sales_lines", "stores", "load_star",
    "append_metrics", "load_dataset", "read_items_csv", "read_sales_csv", "read_stores_csv",
    "save_dataset", "save_history", "save_importance",
]
