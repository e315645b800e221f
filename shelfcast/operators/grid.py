"""Zero-filled panel: every observed (date, store, item) combination, with the
combinations that had no sale added at 0 units.

The grid is the product of the distinct dates, stores and items seen in the
sample (observed values, not a calendar). It is generated, never joined: the
largest of the three key sets stays a distributed DataFrame, hash-partitioned
on that key, and the two smaller sets are inlined as array literals and
exploded row by row. So

* no Cartesian join and no shuffle of grid rows: each task emits its share of
  the grid in place, and every key of the distributed axis emits exactly
  |A| x |B| rows, so a hot key in the facts cannot skew the grid;
* the partition count is chosen from the grid size (rows_per_partition), so
  a task's output stays bounded as the data grows;
* only the two smaller key sets pass through the driver, after their distinct
  counts were checked against ``max_inline``. Dates are bounded by the sampled
  period (<= 366 for a year). A set above the bound never reaches the driver: its
  values are dealt by a hash to blocks of about ``max_inline`` values, every key
  of the axis is paired with the block numbers, and a block's values come from an
  equi-join on (block, salt); only pairs (key, block) move, never grid rows. The
  facts carry the same block and salt, computed from their keys.

The grid keeps the hash partitioning of its distributed axis, so the left join
that aligns the facts, the dimension join on that key and per-item statistics
all reuse it instead of shuffling the grid.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.sample import fill_missing
from shelfcast.schema import KEY

DEFAULT_ROWS_PER_PARTITION = 1_000_000
DEFAULT_MAX_INLINE = 100_000


def key_counts(facts: DataFrame) -> dict:
    """Distinct dates, stores and items of the facts (one aggregation job)."""
    r = facts.agg(*[F.count_distinct(k).alias(k) for k in KEY]).collect()[0]
    return {k: int(r[k]) for k in KEY}


def _inline_values(facts: DataFrame, col: str):
    """Sorted distinct values of a (size-checked) key as one array literal."""
    vals = sorted(r[0] for r in facts.select(col).distinct().collect())
    dtype = facts.schema[col].dataType.simpleString()
    text = ",".join(v.isoformat() if hasattr(v, "isoformat") else str(v) for v in vals)
    # A single string literal, split and cast; Catalyst folds it to a constant array.
    return F.split(F.lit(text), ",").cast(f"array<{dtype}>")


def plan_grid(counts: dict, rows_per_partition: int = DEFAULT_ROWS_PER_PARTITION,
              max_inline: int = DEFAULT_MAX_INLINE, min_partitions: int = 1) -> dict:
    rows = counts["date"] * counts["store_nbr"] * counts["item_nbr"]
    parts = max(1, math.ceil(rows / rows_per_partition), min_partitions)
    # Prefer items as the distributed axis: statistics, normalisation and the item
    # dimension all key on it and then reuse the grid's partitioning. Fall back to
    # the largest key set when there are too few items to fill the partitions.
    if counts["item_nbr"] >= parts or counts["item_nbr"] >= max(counts[k] for k in KEY):
        axis = "item_nbr"
    else:
        axis = max(KEY, key=lambda k: counts[k])
    parts = min(parts, counts[axis]) or 1
    inline = [k for k in KEY if k != axis]
    blocks = {k: math.ceil(counts[k] / max_inline) for k in inline if counts[k] > max_inline}
    salts = max(1, math.ceil(parts / math.prod(blocks.values()))) if blocks else 1
    return {"axis": axis, "inline": inline, "rows": rows, "partitions": parts, "blocks": blocks, "salts": salts}


def _block(plan: dict, key: str):
    """Number of the block a value of ``key`` is in."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(plan["blocks"][key])).cast("int")


def _salt(plan: dict):
    return F.pmod(F.xxhash64(F.lit("salt"), F.col(plan["axis"]).cast("string")), F.lit(plan["salts"])).cast("int")


def placed(df: DataFrame, plan: dict) -> DataFrame:
    """``df`` with the columns by which a grid of blocks is partitioned (none without blocks)."""
    if not plan["blocks"]:
        return df
    return df.withColumns({f"_block_{k}": _block(plan, k) for k in plan["blocks"]} | {"_salt": _salt(plan)})


def place_columns(plan: dict) -> list:
    return [*[f"_block_{k}" for k in plan["blocks"]], "_salt"] if plan["blocks"] else []


def _blocked(facts: DataFrame, plan: dict) -> DataFrame:
    """The axis times every key set above the bound, by joins on (block, salt)."""
    out = facts.select(plan["axis"]).distinct().withColumn("_salt", _salt(plan))
    for k, n in plan["blocks"].items():
        name = f"_block_{k}"
        values = (facts.select(k).distinct().withColumn(name, _block(plan, k)).groupBy(name)
                  .agg(F.collect_list(k).alias("_values")))
        values = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(plan["salts"] - 1))))
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        if k == list(plan["blocks"])[-1]:
            out = out.repartition(plan["partitions"], *place_columns(plan))
        out = out.join(values, [name, "_salt"]).withColumn(k, F.explode("_values")).drop("_values")
    return out


def build_grid(facts: DataFrame, rows_per_partition: int = DEFAULT_ROWS_PER_PARTITION,
               max_inline: int = DEFAULT_MAX_INLINE, counts: dict | None = None):
    """The grid and its plan (distributed axis, partition count, rows).

    Runs two small jobs (distinct counts, then the inlined key lists)."""
    counts = counts or key_counts(facts)
    # at least one partition per core; beyond that the grid size decides
    min_parts = facts.sparkSession.sparkContext.defaultParallelism
    plan = plan_grid(counts, rows_per_partition, max_inline, min_parts)
    axis = plan["axis"]
    if plan["blocks"]:
        out = _blocked(facts, plan)
    else:
        out = facts.select(axis).distinct().repartition(plan["partitions"], axis)
    for k in plan["inline"]:
        if k not in plan["blocks"]:
            out = out.withColumn(k, F.explode(_inline_values(facts, k)))
    return out.select(*KEY, *place_columns(plan)), plan


def grid(facts: DataFrame, rows_per_partition: int = DEFAULT_ROWS_PER_PARTITION,
         max_inline: int = DEFAULT_MAX_INLINE, counts: dict | None = None) -> DataFrame:
    """All (date, store_nbr, item_nbr) combinations of the observed keys."""
    return build_grid(facts, rows_per_partition, max_inline, counts)[0].select(*KEY)


def zero_fill(facts: DataFrame, counts: dict | None = None, **grid_args) -> DataFrame:
    """Facts aligned on the grid (left join on the key), missing rows filled with
    0 units / no promotion. The fact side is the hash-join build side and is
    repartitioned like the grid, so only the facts move: with
    spark.sql.requireAllClusterKeysForCoPartition=false (set by
    session.build_session; safe here because every grid key carries the same
    number of rows) the planner keeps the grid where it is."""
    g, plan = build_grid(facts, counts=counts, **grid_args)
    cols = [c for c in facts.columns if c not in KEY]
    place = place_columns(plan)
    f = placed(facts.select(*KEY, *cols), plan).repartition(plan["partitions"], *(place or [plan["axis"]]))
    return fill_missing(g.join(f.hint("shuffle_hash"), [*KEY, *place], "left").select(*KEY, *cols))


# ---- the panel with the dimensions' columns, aligned without a join on grid rows ----

# Cells (inline keys' product) of one axis key up to which its facts travel as one row.
MAX_PACKED_CELLS = 1_000_000


def packed_plan(facts: DataFrame, counts: dict | None = None, rows_per_partition: int = DEFAULT_ROWS_PER_PARTITION,
                max_inline: int = DEFAULT_MAX_INLINE) -> dict | None:
    """Plan of ``packed_panel`` with the inlined key lists; None where the facts of an axis
    key could outgrow one row, or items are not the axis (then: ``zero_fill``)."""
    counts = counts or key_counts(facts)
    plan = plan_grid(counts, rows_per_partition, max_inline, facts.sparkSession.sparkContext.defaultParallelism)
    if plan["axis"] != "item_nbr" or plan["blocks"] or math.prod(counts[k] for k in plan["inline"]) > MAX_PACKED_CELLS:
        return None
    return plan | {"values": {k: _inline_values(facts, k) for k in plan["inline"]}}


def packed_panel(facts: DataFrame, plan: dict, with_axis=None, with_outer=None) -> DataFrame:
    """The rows of ``zero_fill``, grown from one row an axis key that carries its facts: the
    missing dates of a key, then the missing stores of a date, are added as array
    differences before each explode. Only facts move, whatever the session's join settings.

    ``with_axis`` and ``with_outer`` add columns that depend on the item or on the date: they
    are computed once a key instead of once a grid row."""
    axis, (outer, inner) = plan["axis"], plan["inline"]
    cols = [c for c in facts.columns if c not in KEY]
    types = {f.name: f.dataType for f in facts.schema.fields}
    cell = F.struct(F.col(inner), *cols)
    whole = F.col(outer).isNotNull() & F.col(inner).isNotNull()
    keys = (facts.groupBy(axis, outer).agg(F.collect_list(F.when(whole, cell)).alias("_cells"))
            .groupBy(axis).agg(F.collect_list(F.when(F.col(outer).isNotNull(), F.struct(outer, "_cells"))).alias("_slices")))
    cells_type = keys.schema["_slices"].dataType.elementType["_cells"].dataType
    if with_axis is not None:
        keys = with_axis(keys)
    keys = keys.repartition(plan["partitions"], axis)

    def filled(values):
        return F.transform(values, lambda v: F.struct(v.alias(inner), *[F.lit(None).cast(types[c]).alias(c) for c in cols]))

    dates, stores = plan["values"][outer], plan["values"][inner]
    others = F.array_except(dates, F.transform("_slices", lambda d: d[outer]))
    slices = F.concat("_slices", F.transform(others, lambda v: F.struct(v.alias(outer), F.array().cast(cells_type).alias("_cells"))))
    rest = [c for c in keys.columns if c != "_slices"]
    # the arrays are made in projections of their own: their functions have no generated code, the explodes do
    days = (keys.select(*rest, filled(stores).alias("_empty"), slices.alias("_all"))
            .select(*rest, "_empty", F.explode("_all").alias("_slice"))
            .select(*rest, "_empty", F.col(f"_slice.{outer}").alias(outer), F.col("_slice._cells").alias("_cells")))
    if with_outer is not None:
        days = with_outer(days)
    more = filled(F.array_except(stores, F.transform("_cells", lambda c: c[inner])))
    cells = F.when(F.size("_cells") == 0, F.col("_empty")).otherwise(F.concat("_cells", more))
    rest = [c for c in days.columns if c not in ("_empty", "_cells")]
    out = days.select(*rest, cells.alias("_all")).select(*rest, F.explode("_all").alias("_cell"))
    out = out.select(*rest, *[F.col(f"_cell.{c}").alias(c) for c in (inner, *cols)])
    front = [*KEY, *cols]
    return fill_missing(out.select(*front, *[c for c in out.columns if c not in front]))
