"""Reproducible row assignment by key hash.

``randomSplit`` depends on partitioning and row order, so a recomputed partition
after executor loss can move rows between sides. A hash of the row key does not:
the same key lands on the same side in any plan, on any cluster, and in the
DuckDB oracle (md5 is available in both engines).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SEED = 42


def key_hash(seed, *cols: str, salt: str | None = None) -> Column:
    """Unsigned 32-bit integer from the first 8 hex digits of
    md5('seed|k1|k2|...'), optionally prefixed by a salt."""
    parts = (([F.lit(salt)] if salt else []) + ([F.lit(str(seed))] if seed is not None else [])
             + [F.col(c) for c in cols])
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def train_flag(seed=DEFAULT_SEED, test_size: float = 0.2,
               cols=("store_nbr", "item_nbr", "date")) -> Column:
    """True for the training side of a (1 - test_size) / test_size split.

    The hash is read as a number in [0, 1): its last decimal digit gives the
    tenths, the rest of it the finer places. A size of whole tenths is judged by
    that digit alone, so that the hash is taken once: a filter's expression that
    names it twice is computed twice."""
    h = key_hash(seed, *cols)
    tenths = round(10 * (1.0 - test_size))
    if round(1.0 - test_size, 9) == tenths / 10:
        return h % 10 < F.lit(tenths)
    place = (h % 10 + F.floor(h / 10) / F.lit(float(2 ** 32 // 10 + 1))) / 10
    return place < F.lit(round(1.0 - test_size, 9))


def fold_of(k: int, seed=DEFAULT_SEED, cols=("store_nbr", "item_nbr", "date")) -> Column:
    """Fold number 0..k-1; salted so folds are independent of the 80/20 split."""
    return (key_hash(seed, *cols, salt="fold") % k).cast("int")
