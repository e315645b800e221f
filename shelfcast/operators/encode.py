"""Categorical encodings fitted on the training rows and applied to any frame.

The vocabulary of a categorical column (its distinct values) is usually small and
bounded by the dimension tables; it is fitted with one distributed distinct
job and checked against ``max_categories`` before it is brought to the driver.
Columns beyond that bound are numbered without the driver: ``rank_table`` sorts
the distinct values by range and joins the codes to the rows; their one-hot form
is a sparse vector (``one_hot_vectors``) instead of one column a value.
"""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.session import checkpoint_dir

MAX_CATEGORIES = 100_000
_ROW_BITS = 33          # monotonically_increasing_id: part number above, row in the part below


def vocabulary(df: DataFrame, col: str, max_categories: int = MAX_CATEGORIES) -> list:
    d = df.select(col).filter(F.col(col).isNotNull()).distinct()
    n = d.count()
    if n > max_categories:
        raise ValueError(f"{col}: {n} categories > {max_categories}")
    return sorted(r[0] for r in d.collect())


def fit_label_encoder(train: DataFrame, cols):
    """Sorted distinct values -> 0..n-1; an unseen value in ``transform`` raises.
    MLlib StringIndexer keeps nominal attributes, so the trees treat the codes
    as categories."""
    from pyspark.ml import Pipeline
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", stringOrderType="alphabetAsc",
                            handleInvalid="error") for c in cols]
    return Pipeline(stages=stages).fit(train)


def apply_label_encoder(model, df: DataFrame, cols, as_int: bool = False) -> DataFrame:
    out = model.transform(df)
    for c in cols:
        code = F.col(f"{c}__idx").cast("int") if as_int else F.col(f"{c}__idx")
        out = out.withColumn(c, code).drop(f"{c}__idx")
    return out


def label_encode(train: DataFrame, test: DataFrame, cols, as_int: bool = False, fit_on: DataFrame | None = None):
    """Codes fitted on ``fit_on`` (rows with the training values of ``cols``; default: ``train``)."""
    model = fit_label_encoder(train if fit_on is None else fit_on, cols)
    return (apply_label_encoder(model, train, cols, as_int),
            apply_label_encoder(model, test, cols, as_int), model)


def one_hot_columns(vocab: dict) -> list:
    return [f"{c}_{v}" for c in vocab for v in vocab[c]]


def one_hot(df: DataFrame, vocab: dict) -> DataFrame:
    """One 0/1 column per (column, value) of the fitted vocabulary, named
    ``col_value`` in sorted order; NULL or unseen values give all zeros. Both
    sides of a split get the same columns because the vocabulary is shared."""
    cols = {f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
            for c in vocab for v in vocab[c]}
    return df.withColumns(cols).drop(*vocab.keys())


def fit_one_hot(train: DataFrame, cols, max_categories: int = MAX_CATEGORIES) -> dict:
    return {c: vocabulary(train, c, max_categories) for c in cols}


# ---- vocabularies of any size ----

def rank_table(df: DataFrame, col: str) -> DataFrame:
    """(value, code): the distinct values of ``col`` in sorted order, numbered from 0;
    NULL has no code. Parts of a range sort are numbered within and then moved on by
    the sizes of the parts before, so the driver sees one number a part, never the
    values. The sorted values are checkpointed: their part numbers must not change."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    v = df.select(F.col(col).alias("value")).filter(F.col("value").isNotNull()).distinct()
    v = v.repartitionByRange("value").sortWithinPartitions("value").withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    part, at = F.shiftright("_id", _ROW_BITS), F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    v = v.select("value", part.alias("_part"), at.alias("_at"))
    before, total = [], 0
    for part_no, n in sorted(tuple(r) for r in v.groupBy("_part").count().collect()):
        before.append((part_no, total))
        total += n
    offsets = spark.createDataFrame(before, "_part long, _before long")     # one row a part
    return v.join(F.broadcast(offsets), "_part").select("value", (F.col("_before") + F.col("_at")).alias("code"))


def _coded(df: DataFrame, tables: dict, missing) -> DataFrame:
    """Values of the columns replaced by their codes; ``missing(col)`` where there is none."""
    for c, t in tables.items():
        t = t.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        df = df.join(t, F.col(c) == F.col("_value"), "left")
        df = df.withColumn(c, F.when(F.col("_code").isNull(), missing(c)).otherwise(F.col("_code"))).drop("_value", "_code")
    return df


def label_encode_by_rank(train: DataFrame, test: DataFrame, cols):
    """``label_encode`` with integer codes for vocabularies of any size: (train, test,
    rank tables). A value without a code, NULL included, raises when rows are read."""
    tables = {c: rank_table(train, c) for c in cols}

    def unseen(c):
        return F.raise_error(F.concat(F.lit(f"{c}: unseen value "), F.coalesce(F.col(c).cast("string"), F.lit("NULL")))).cast("long")

    return _coded(train, tables, unseen), _coded(test, tables, unseen), tables


def one_hot_vectors(train: DataFrame, test: DataFrame, cols, out: str = "one_hot"):
    """(train, test, sizes) with one sparse 0/1 vector ``out`` in place of ``cols``: for
    each column one place a value, in the order of ``one_hot``; NULL and unseen values
    are all zeros."""
    tables = {c: rank_table(train, c) for c in cols}
    sizes = {c: t.count() for c, t in tables.items()}
    some = [c for c in cols if sizes[c]]
    names = {c: f"_{out}_{c}" for c in some}
    if some:
        # fitted on the largest code of each column; what lies beyond it is "invalid", the dropped last place
        top = train.sparkSession.createDataFrame([tuple(float(sizes[c] - 1) for c in some)], ", ".join(f"`{c}` double" for c in some))
        model = OneHotEncoder(inputCols=some, outputCols=[names[c] for c in some], handleInvalid="keep", dropLast=True).fit(top)
        join = VectorAssembler(inputCols=[names[c] for c in some], outputCol=out)

    def apply(df):
        if not some:
            return df.drop(*cols)
        coded = _coded(df, {c: tables[c] for c in some}, lambda c: F.lit(sizes[c]).cast("long"))
        return join.transform(model.transform(coded.withColumns({c: F.col(c).cast("double") for c in some}))).drop(*cols, *names.values())

    return apply(train), apply(test), sizes
