"""Dataset preparation: the sampled, zero-filled, enriched training set and the
test set of the following year, then the model-ready frames.

Training rows: one year of perishable items, zero-filled over the observed
dates x stores x items. Test rows: the next year, same segment, not filled.
Model frames: units z-scored per item with training statistics (items unseen
in training are dropped from the test side), unused columns dropped,
categories label-encoded (trees) or one-hot encoded (MLP), rows split 80/20
by key hash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators import encode, grid as G, sample, split, stats
from shelfcast.functions.calendar import date_features
from shelfcast.operators.enrich import SET_COLUMNS, build_set
from shelfcast.schema import CATEGORICAL, UNUSED_COLUMNS
from shelfcast.sources import star

# The sampled periods (training year, test year) of the test data.
TRAIN_START, TRAIN_END = "1996-01-01", "1996-12-31"
TEST_START, TEST_END = "1997-01-01", "1997-12-31"


@dataclass
class Dataset:
    train: DataFrame                 # zero-filled training set
    test: DataFrame                  # next year, not filled
    facts: DataFrame                 # sampled training facts (persisted)
    counts: dict = field(default_factory=dict)   # distinct dates / stores / items
    stores: DataFrame | None = None
    items: DataFrame | None = None
    plan: dict | None = None         # of the packed grid; None: the grid is aligned by a join


def sampled_facts(sales: DataFrame, items: DataFrame, start=TRAIN_START, end=TRAIN_END) -> DataFrame:
    """Perishable facts of the period, persisted: the grid reads them three
    times (counts, key lists, alignment) and must not rescan the fact table."""
    return sample.sample_perishable(sales, items, start, end).persist(StorageLevel.MEMORY_AND_DISK)


def item_side(items: DataFrame) -> DataFrame:
    """The item table as a side of a join with facts or keys: sorted and merged, not broadcast. A plan
    judges the table by the size of its files, some 4 bytes an item; a broadcast takes 40 to 64 bytes
    an item of the driver, for every join."""
    return items.hint("merge")


def train_panel(facts: DataFrame, counts: dict | None = None, **grid_args) -> DataFrame:
    counts = counts or G.key_counts(facts)
    return G.zero_fill(facts, counts=counts, **grid_args)


def train_set(facts: DataFrame, stores: DataFrame, items: DataFrame, counts: dict, plan: dict | None,
              item_columns: DataFrame | None = None, item_date: bool = False, **grid_args) -> DataFrame:
    """The zero-filled panel with dimensions and calendar (inner joins, as in ``build_set``),
    and the columns of ``item_columns`` (item_nbr, ...), rows of items without them dropped.
    ``item_date`` adds the text that ``split`` hashes (``split.ITEM_DATE``).

    The item's columns and the date's are attached before the grid's rows are made."""
    extra = [] if item_columns is None else [c for c in item_columns.columns if c != "item_nbr"]
    if plan is None:
        out = build_set(train_panel(facts, counts, **grid_args), stores, items)
        out = out if item_columns is None else out.join(item_columns, "item_nbr").select(*SET_COLUMNS, *extra)
        return split.with_item_date(out) if item_date else out

    def with_item(keys):
        keys = keys.join(item_side(items), "item_nbr")
        return keys if item_columns is None else keys.join(item_columns, "item_nbr")

    # the grid's stores were counted (at most max_inline): their rows are the side to broadcast. Sizes
    # can't tell, for a plan knows the grid by the few rows that it is grown from.
    there = stores.join(facts.select("store_nbr").distinct(), "store_nbr", "left_semi")
    def with_date(days):
        return split.with_item_date(date_features(days)) if item_date else date_features(days)

    out = G.packed_panel(facts, plan, with_item, with_date).join(F.broadcast(there), "store_nbr")
    return out.select(*SET_COLUMNS, *extra, *([split.ITEM_DATE] if item_date else []))


def build_dataset(sales: DataFrame, stores: DataFrame, items: DataFrame,
                  train_period=(TRAIN_START, TRAIN_END), test_period=(TEST_START, TEST_END),
                  check_key: bool = False, **grid_args) -> Dataset:
    facts = sampled_facts(sales, items, *train_period)
    if check_key:
        sample.assert_unique_key(facts)
    counts = G.key_counts(facts)
    plan = G.packed_plan(facts, counts, **grid_args)
    train = train_set(facts, stores, items, counts, plan, **grid_args)
    test_facts = sample.fill_missing(sample.sample_perishable(sales, items, *test_period))
    test = build_set(test_facts, stores, item_side(items))
    return Dataset(train, test, facts, counts, stores, items, plan)


def load(spark: SparkSession, sf_dir: str, **kw) -> Dataset:
    s, st, it = star.load_star(spark, sf_dir)
    return build_dataset(s, st, it, **kw)


def matched_stores(ds: Dataset, stores: DataFrame) -> int:
    """Grid stores with a store row (one small job per dataset)."""
    if "matched_stores" not in ds.counts:
        ds.counts["matched_stores"] = (ds.facts.select("store_nbr").distinct()
                                       .join(stores.select("store_nbr"), "store_nbr", "left_semi").count())
    return ds.counts["matched_stores"]


def sparse_stats(ds: Dataset, stores: DataFrame, items: DataFrame) -> DataFrame:
    """Training-set item statistics without reading the zero-filled rows.

    Panel rows per item = dates x (grid stores with a store row); facts are
    restricted to stores and items that survive the dimension joins."""
    n_stores = matched_stores(ds, stores)
    facts = (ds.facts.join(stores.select("store_nbr"), "store_nbr", "left_semi")
             .join(item_side(items.select("item_nbr")), "item_nbr", "left_semi"))
    return stats.item_stats_sparse(facts, ds.counts["date"] * n_stores)


@dataclass
class ModelFrames:
    train: DataFrame       # normalised, encoded, with is_train (80/20 by key hash)
    test: DataFrame        # normalised, encoded
    stats: DataFrame       # item_nbr, mean, std
    encoder: object = None  # fitted label encoder or one-hot vocabulary


def normalised(ds: Dataset, item_stats: DataFrame | None = None, sparse: bool = True, item_date: bool = False):
    """Fill, per-item statistics of the training rows, z-score both sides, drop
    the columns the models never use.

    By default the statistics come from the observed facts (``sparse_stats``):
    the grid is then generated once, for the rows being normalised, instead of
    once more for an aggregate over all of it. ``item_date``: the training rows carry
    the text that ``split`` hashes."""
    train = sample.fill_missing(ds.train)
    test = sample.fill_missing(ds.test)
    if item_stats is not None:
        st = item_stats
    elif sparse and ds.stores is not None:
        st = sparse_stats(ds, ds.stores, ds.items)
    else:
        st = stats.item_stats(train)
    if ds.plan is not None:      # the statistics join the items, not the grid's rows
        train_n = stats.standardise(sample.fill_missing(train_set(ds.facts, ds.stores, ds.items, ds.counts, ds.plan, st, item_date)))
    else:
        train_n = stats.normalise(train, st)
        train_n = split.with_item_date(train_n) if item_date else train_n
    train_n = train_n.drop(*UNUSED_COLUMNS)
    test_n = stats.normalise(test, st).drop(*UNUSED_COLUMNS)
    return train_n, test_n, st


def category_rows(ds: Dataset, st: DataFrame) -> DataFrame:
    """Rows that hold every value of the dimension columns of the normalised training rows:
    each item with one store, each store with one item. The panel is the product of its
    items, stores and dates, so a vocabulary of these rows is that of all; where the product
    is empty, so are these."""
    own = ds.facts.select("item_nbr").distinct().join(item_side(ds.items), "item_nbr").join(st.select("item_nbr"), "item_nbr", "left_semi")
    there = ds.facts.select("store_nbr").distinct().join(ds.stores, "store_nbr")
    return own.crossJoin(there.limit(1)).unionByName(own.limit(1).crossJoin(there))


def _fit_rows(ds: Dataset, st: DataFrame) -> DataFrame | None:
    # a dataset that was read back carries no key sets: its vocabularies come from its rows
    return None if ds.plan is None else category_rows(ds, st)


def tree_frames(ds: Dataset, item_stats: DataFrame | None = None, test_size: float = 0.2,
                seed=42) -> ModelFrames:
    """Label-encoded frames for the boosted trees (codes as doubles carrying
    nominal ML attributes)."""
    frames = normalised(ds, item_stats)
    return encode_trees(*frames, test_size, seed, fit_on=_fit_rows(ds, frames[2]))


def encode_trees(train_n: DataFrame, test_n: DataFrame, st: DataFrame, test_size: float = 0.2,
                 seed=42, fit_on: DataFrame | None = None) -> ModelFrames:
    """Label codes fitted on the normalised training rows, applied to both sides."""
    train_e, test_e, enc = encode.label_encode(train_n, test_n, CATEGORICAL, fit_on=fit_on)
    train_e = split.with_split(train_e.withColumn("onpromotion", F.col("onpromotion").cast("double")),
                               test_size, seed)
    test_e = test_e.withColumn("onpromotion", F.col("onpromotion").cast("double"))
    return ModelFrames(train_e, test_e, st, enc)


def mlp_frames(ds: Dataset, item_stats: DataFrame | None = None, test_size: float = 0.2,
               seed=42) -> ModelFrames:
    """One-hot frames for the MLP; the vocabulary is fitted on training rows."""
    frames = normalised(ds, item_stats)
    return encode_mlp(*frames, test_size, seed, fit_on=_fit_rows(ds, frames[2]))


def encode_mlp(train_n: DataFrame, test_n: DataFrame, st: DataFrame, test_size: float = 0.2,
               seed=42, fit_on: DataFrame | None = None) -> ModelFrames:
    """One-hot columns from the training vocabulary, on both sides."""
    vocab = encode.fit_one_hot(train_n if fit_on is None else fit_on, CATEGORICAL)
    cast = {"onpromotion": F.col("onpromotion").cast("int")}
    train_e = split.with_split(encode.one_hot(train_n, vocab).withColumns(cast), test_size, seed)
    test_e = encode.one_hot(test_n, vocab).withColumns(cast)
    return ModelFrames(train_e, test_e, st, vocab)
