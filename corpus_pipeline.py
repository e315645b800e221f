"""Training-data pipeline over the documents table: quality classifier, line
dedup, n-gram Jaccard join, benchmark decontamination, byte-level BPE.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all documents
its predecessor kept; its result is written as Parquet and read again as the
next stage's input. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import bpe, decontaminate, jaccard, line_dedup, quality
from shelfcast.llm.common import materialise, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects (low quality or toxic) go."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.filter(~F.col("quality_class.rejected")).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines covered by later occurrences of three-line windows go; n_chars follows the
    text. A document of which nothing is left stays, with an empty text."""
    r = line_dedup.dedup_lines(docs)
    text = F.col("line_dedup.text")
    changed = {"text": text, "n_chars": F.when(F.col("line_dedup.n_removed") > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))}
    return r.select([changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays (rows
    equal in id and text count as one; documents without words are all kept)."""
    j = jaccard.join(docs)
    keep = materialise(j.filter((F.col("n_shingles") == 0) | F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))
                       .select(F.col("doc_id").alias("i"), "th").distinct(), "pipeline-keep")
    d = docs.alias("d")
    return d.join(keep.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.i")) & (F.xxhash64("d.text") == F.col("k.th")), "left_semi")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which test items cover a twentieth of the words or more go; the others stay as they are."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its number of tokens and digests of the ids and of the decoded bytes."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: The classifier and the tokenizer have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
