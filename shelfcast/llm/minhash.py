"""Document fingerprints by MinHash.

A document's words (A-Z lower-cased, cut at ASCII white space) make shingles of
five; fewer words make one shingle of all of them. Each shingle is hashed to 64
bits and goes through ``PERMS`` universal hash functions (multiply-shift with
odd multipliers), vectorised in numpy; the minimum of each is a lane of 16 bits
of the fingerprint. The share of equal lanes estimates the Jaccard likeness.

Near-duplicates: the lanes form bands; texts whose band agrees, by the hash of
(band, value), are a group. Groups go through the rounds of the Jaccard join
(``jaccard.list_links``): in a small group all pairs are held against parity
sketches, in a large one each member is compared with the head (smallest text
hash), those near to it meet on their differences from it, and those far from
it are grouped again. The Jaccard likeness of the real shingle sets is verified
(``PERCENT`` or more), and the links span the components of all links between
texts that share a band. Every document gets the smallest id of its component
as class id.

The edited text of the contract needs each document's successor in descending
id order: texts, compressed, are exchanged once by id ranges; the first row of
each range is sent to the preceding range as well, so tasks stream through
neighbours.

Edge cases: null texts count as empty; an empty text has no shingles, lanes all
ones, and is like another empty one only; equal texts have equal fingerprints;
equal ids are ordered by the hash of their text, null ids come last; one document is its own
successor; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.llm.common import U64, components, discard, materialise, mix64, parted, prepare, shingle_sets, sliced, table, thinned
from shelfcast.llm.jaccard import SKETCH_WORDS, counted_shingles, frequent_order, list_links

PERMS = 128
BANDS = 32            # of PERMS / BANDS lanes
SHINGLE = 5
PERCENT = 80          # least Jaccard likeness of a link
NEAR = 40             # distance (%) up to which a head settles a member: that of two links at least
ROWS_A_RANGE = 20_000
_EMPTY_LANES = np.full(PERMS, 0xFFFF, np.uint16)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and increments, from one fixed seed."""
    i = np.arange(1, 2 * PERMS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        r = mix64(i * U64(0x9E3779B97F4A7C15))
    return r[:PERMS] | U64(1), r[PERMS:]


def signature(hashes: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """PERMS lanes of 16 bits."""
    if len(hashes) == 0:
        return _EMPTY_LANES
    a, b = _coefficients()
    low = np.full(PERMS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), chunk):
        x = hashes[i:i + chunk]
        np.minimum(low, (a[:, None] * x[None, :] + b[:, None]).min(1), out=low)
    return (mix64(low) >> U64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if (a is _EMPTY_LANES) != (b is _EMPTY_LANES):
        return 0.0
    return float(np.count_nonzero(a == b)) / PERMS


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Per document: id, text hash ``th``, lanes as binary."""
    prepare(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("th", T.LongType()),
                           T.StructField("lanes", T.BinaryType())])

    def run(batches):
        from shelfcast.llm import minhash as M
        for b in batches:
            got = [M.signature(h).tobytes() for h in M.shingle_sets(b.column(2).to_pylist(), M.SHINGLE)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.binary())],
                                             names=[f.name for f in schema.fields])

    return docs.select(F.col(id_col), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def bands(prints: DataFrame) -> DataFrame:
    """(th, key): the text hash once per band of its lanes."""
    width = 2 * PERMS // BANDS
    keys = [F.xxhash64(F.lit(i), F.col("lanes").substr(i * width + 1, width)) for i in range(BANDS)]
    return prints.select("th", F.explode(F.array(*keys)).alias("key"))


def near_pairs(docs: DataFrame, prints: DataFrame, id_col="doc_id", text_col="text", percent: int = PERCENT) -> DataFrame:
    """(id, th, near_id, near_th, jaccard): verified links between different
    texts that share a band; they span the same components as all such links.
    ``prints``: (id, th, lanes), read twice. Equal texts share one
    representative, their smallest id."""
    spark = docs.sparkSession
    prepare(spark)
    # dealt by band once: the groups of different texts and their members are read from the same exchange
    dealt = bands(prints).repartition("key")
    heads = dealt.groupBy("key").agg(F.min("th").alias("head"), F.max("th").alias("last")).filter("head <> last").select("key")
    members = materialise(dealt.join(heads.hint("merge"), "key", "left_semi").distinct().select(F.col("key").alias("token"), F.col("th").alias("sid")),
                          "minhash-members")
    # the head of a group is its smallest hash
    size = members.groupBy("token").agg(F.count("*").alias("c"))
    lists = materialise(members.join(size, "token").withColumn("rare", F.lit(0)), "minhash-lists")
    asked = members.select(F.col("sid").alias("th")).distinct()
    asked = prints.select(F.col(id_col).alias("i"), "th").join(asked, "th", "left_semi").groupBy("th").agg(F.min("i").alias("i"))
    # the real shingle sets of the documents that share a band with another
    texts = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    asked = materialise(asked, "minhash-asked")
    discard(members)
    texts = thinned(texts, asked).join(asked, texts["i"].eqNullSafe(asked["i"]) & (texts["th"] == asked["th"]), "left_semi").dropDuplicates(["i", "th"])

    def sets(batches):
        from shelfcast.llm import jaccard as J
        from shelfcast.llm import minhash as M
        for b in M.sliced(batches):
            got = M.shingle_sets(b.column(1).to_pylist(), M.SHINGLE)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in got], pa.int32()), J.sketches(got), J.wide_sketches(got),
                                              pa.array([h.tobytes() for h in got], pa.binary())], names=["sid", "n", "sketch", "wide", "hashes"])

    s = materialise(texts.select("th", "t").mapInArrow(sets, "sid bigint, n int, sketch array<bigint>, wide binary, hashes binary"), "minhash-sets")
    values = frequent_order(counted_shingles(s))
    frequent = (hashlib.blake2b(values.tobytes()).hexdigest(), spark.sparkContext.broadcast(values))  # 4 MB
    links = list_links(lists, s.filter("n > 0").select("sid", "n", "sketch", "wide"), lambda wanted: s, frequent, [], percent=percent, near=NEAR,
                       words=SKETCH_WORDS)    # many that share a band are unlike: pairs meet with all of the sketch
    discard(lists, s)
    links = links.groupBy(F.greatest("a", "b").alias("th"), F.least("a", "b").alias("near_th")).agg(
        F.first(F.col("common") / (F.col("n1") + F.col("n2") - F.col("common"))).alias("jaccard"))
    return (links.join(asked.select("th", F.col("i").alias("id")), "th")
            .join(asked.select(F.col("th").alias("near_th"), F.col("i").alias("near_id")), "near_th")
            .select("id", "th", "near_id", "near_th", "jaccard"))


def classes(prints: DataFrame, near: DataFrame, id_col="doc_id") -> DataFrame:
    """(th, class_id, near_id) of every text that is linked or occurs more than
    once: the smallest id of its component, and of the texts it is verified with."""
    partner = (near.select("th", "near_id").union(near.select(F.col("near_th").alias("th"), F.col("id").alias("near_id")))
               .groupBy("th").agg(F.min("near_id").alias("near_id")))
    root = components(near.select(F.col("th").alias("a"), F.col("near_th").alias("b")))
    root = root.union(root.select("root", "root").distinct()).withColumnRenamed("node", "th")
    own = prints.groupBy("th").agg(F.min(id_col).alias("i"), F.count("*").alias("c")).join(root, "th", "left")
    own = materialise(own.filter("c > 1 or root is not null").select("th", "i", F.coalesce("root", "th").alias("root")), "minhash-roots")
    least = own.groupBy("root").agg(F.min("i").alias("class_id"))
    return own.join(least, "root").select("th", "class_id").join(partner, "th", "left")


# ---- neighbours in id order ----

def ranges(ids: list, cuts: np.ndarray) -> np.ndarray:
    """The range of each id, largest ids first; ``cuts`` ascend. Nulls are in the last."""
    values = np.array([-np.inf if i is None else float(i) for i in ids])
    return (len(cuts) - np.searchsorted(cuts, values, side="right")).astype(np.int32)


def neighbours(docs: DataFrame, id_col="doc_id", text_col="text", rows_a_range: int = ROWS_A_RANGE) -> tuple[DataFrame, int]:
    """Rows (part, own, i, th, z) such that each part, sorted by (i descending
    with nulls last, th), holds a run of consecutive documents and, as its last
    rows (own = false), those that start the run which follows; after the last
    document the first. z is the compressed text. Second: the number of parts.
    The driver holds one id per ``rows_a_range`` rows."""
    spark = docs.sparkSession
    prepare(spark)
    parts = max(1, -(-docs.count() // rows_a_range))
    cuts = np.array(sorted(set(docs.approxQuantile(id_col, [i / parts for i in range(1, parts)], 0.1 / parts)) if parts > 1 else []), float)
    kind = docs.schema[id_col].dataType

    def place(batches):
        from shelfcast.llm import minhash as M
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(M.ranges(b.column(0).to_pylist(), cuts)), b.column(0)], names=["part", "i"])

    placed = docs.select(id_col).mapInArrow(place, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("i", kind)]))
    firsts = {r.part: r.i for r in placed.groupBy("part").agg(F.max("i").alias("i")).collect()}
    used = sorted(firsts)
    before = {p: used[k - 1] for k, p in enumerate(used)}          # the range that precedes, cyclic
    spread = spark.sparkContext.broadcast((cuts, firsts, before))  # one id per range of rows
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("own", T.BooleanType()), T.StructField("i", kind),
                           T.StructField("th", T.LongType()), T.StructField("z", T.BinaryType())])

    def send(batches):
        from shelfcast.llm import minhash as M
        cuts, firsts, before = spread.value
        pack = zstandard.ZstdCompressor().compress
        for b in M.sliced(batches):
            ids = b.column(0).to_pylist()
            part = M.ranges(ids, cuts)
            lead = [k for k, (p, i) in enumerate(zip(part.tolist(), ids)) if firsts[p] is None or firsts[p] == i]
            z = [pack(t) for t in b.column(2).cast(pa.binary()).to_pylist()]
            at = pa.array(np.append(np.arange(len(ids)), lead).astype(np.int64))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.append(part, [before[part[k]] for k in lead]).astype(np.int32)),
                pa.array(np.arange(len(at)) < len(ids)), b.column(0).take(at), b.column(1).take(at),
                pa.array(z + [z[k] for k in lead], pa.binary())], names=schema.names)

    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), F.xxhash64(t).alias("th"), t.alias("t")).mapInArrow(send, schema), max(1, len(used))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half] if half else text


RESULT = "n_chars long, sha binary, lanes binary, edited_lanes binary, near_edited double, near_next double, th long"


def edits(docs: DataFrame, id_col="doc_id", text_col="text", rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """Lanes of every text and of its edited text, the digest of the latter, and
    the likeness to it and to the next document; th is the hash of the text."""
    rows, n = neighbours(docs, id_col, text_col, rows_a_range)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + T._parse_datatype_string(RESULT).fields)
    ranged = rows.repartition(n, "part").sortWithinPartitions("part", F.desc("own"), F.desc_nulls_last("i"), "th")

    def run(batches):
        from shelfcast.llm import minhash as M
        unpack = zstandard.ZstdDecompressor().decompress
        held = None      # (part, id, text, th, lanes) still waiting for its successor
        closed = None    # the part whose borrowed row has been used
        for b in M.sliced(batches):
            ready = []
            rows = [(*r[:4], unpack(r[4]).decode()) for r in zip(*(c.to_pylist() for c in b.columns))]
            for (part, own, i, th, t), h in zip(rows, M.shingle_sets([r[4] for r in rows], M.SHINGLE)):
                if not own and closed == part:
                    continue
                lanes = M.signature(h)
                if held is not None and held[0] == part:
                    ready.append((held, t, lanes))
                held = (part, i, t, th, lanes) if own else None
                if not own:
                    closed = part
            out = M.results(ready)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=M.arrow_schema(b, schema))

    return ranged.mapInArrow(run, schema)


def with_edits(docs: DataFrame, id_col="doc_id", text_col="text", rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """Fingerprints (hexadecimal) of every text and of its edited text, and their likeness."""
    return readable(edits(docs, id_col, text_col, rows_a_range))


def readable(r: DataFrame) -> DataFrame:
    hexed = {"edited_sha256": "sha", "fingerprint": "lanes", "edited_fingerprint": "edited_lanes"}
    return r.withColumns({new: F.lower(F.hex(old)) for new, old in hexed.items()}).drop("sha", "edited_lanes")


def arrow_schema(batch, schema):
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(schema.names[0], batch.schema.field(2).type)] + [(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields[1:]])


def results(ready: list) -> list[tuple]:
    texts = [edited(held[2], following) for held, following, _ in ready]
    out = []
    for (held, _, lanes_next), e, h in zip(ready, texts, shingle_sets(texts, SHINGLE)):
        _, i, t, th, lanes = held
        le = signature(h)
        out.append((i, len(t), hashlib.sha256(e.encode()).digest(), lanes.tobytes(), le.tobytes(),
                    likeness(lanes, le), likeness(lanes, lanes_next), th))
    return out


def op9_minhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    r = materialise(edits(docs), "minhash-fingerprints")
    near = materialise(near_pairs(docs.withColumn("text", F.coalesce("text", F.lit(""))), r.select("doc_id", "th", "lanes")), "minhash-near")
    best = materialise(classes(r.select("doc_id", "th"), near), "minhash-classes")
    # only texts that may have a class of their own move, with their lanes
    some, others = parted(r, best)
    return readable(some.join(best, "th", "left").unionByName(others, allowMissingColumns=True)).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_id",
        F.coalesce("class_id", "doc_id").alias("class_id"))
