"""Shared helpers of the training-data operators: table scans, shared-folder
tables, bounded blocks of a small table, numpy hashing."""

from __future__ import annotations

import uuid
from collections import OrderedDict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.session import checkpoint_dir, ship_package

U64 = np.uint64
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage with a table in the shared folder; survives lost executors.
    The shuffle files of the write go when it has ended: nothing reads them again."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` from which nothing more is read."""
    for df in tables:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def prepare(spark: SparkSession) -> None:
    """What every operator with Python tasks needs: the package on the workers."""
    ship_package(spark)


def mix64(x):
    """Finaliser over uint64 arrays (wraps modulo 2^64)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CHUNK = 1 << 20
_WORD_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _WORD_POWERS
    if len(_WORD_POWERS) < n:
        p = np.full(max(n, 1024), U64(0xBF58476D1CE4E5B9), np.uint64)
        p[0] = 1
        _WORD_POWERS = np.cumprod(p)
    return _WORD_POWERS


def _chained(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes."""
    m = len(words) - k + 1
    h = np.full(m, U64(k), np.uint64)
    for j in range(k):
        h = mix64(h * U64(0x9E3779B97F4A7C15) + words[j:j + m])
    return h


def shingle_sets(texts: list, n: int) -> list[np.ndarray]:
    """For each text the distinct 64-bit hashes, ascending, of its shingles of
    ``n`` words: A-Z lower-cased, cut at ASCII white space; fewer words are one
    shingle. Vectorised over about a megabyte of texts at a time."""
    out: list[np.ndarray] = []
    raw: list[bytes] = []
    held = 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if raw and held + len(b) > _CHUNK:
            out += _shingle_chunk(raw, n)
            raw, held = [], 0
        raw.append(b)
        held += len(b) + 1
    return out + (_shingle_chunk(raw, n) if raw else [])


def _shingle_chunk(raw: list[bytes], n: int) -> list[np.ndarray]:
    x = np.frombuffer(b" " + b" ".join(raw).lower() + b" ", np.uint8)
    space = _SPACE[x]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    none = np.zeros(0, np.uint64)
    if not len(starts):
        return [none] * len(raw)
    at = np.arange(len(x)) - np.repeat(np.append(0, starts), np.diff(np.append(0, np.append(starts, len(x)))))
    at[space] = 0
    value = (x.astype(np.uint64) + U64(1)) * _powers(int(at.max()) + 1)[at]
    value[space] = 0
    words = mix64(np.add.reduceat(value, starts))
    size = np.array([len(b) + 1 for b in raw])
    first = np.searchsorted(starts, np.append(1, 1 + np.cumsum(size)))    # first word of each text
    runs = _chained(words, n) if len(words) >= n else none
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        if z - a >= n:
            out.append(np.unique(runs[a:z - n + 1]))
        else:
            out.append(_chained(words[a:z], z - a) if z > a else none)
    return out


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    return shingle_sets([text], n)[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of edges (a, b) of longs; the
    root is the smallest node. Alternates large-star and small-star until the
    edges are stars: a logarithmic number of rounds, and a hub's edges are an
    aggregate and a join, never one group."""
    def stamp(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = materialise(e, "components")
    seen = stamp(e)
    while seen[0]:
        last = e
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lower = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "components-min")
        large = both.join(lower, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialise(large, "components-large")       # a > b throughout
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "components-min")
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
                 .union(least.select("a", F.col("m").alias("b"))).distinct())
        e = materialise(small, "components")
        discard(last, lower, large, least)
        now = stamp(e)
        if now == seen:
            break
        seen = now
    out = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._shared_path = e._shared_path
    return out


SLOTS = 1 << 18


def thinned(rows: DataFrame, keys: DataFrame, key: str = "th") -> DataFrame:
    """``rows`` without most of those whose (long) key is not in ``keys``, ahead
    of a join: a broadcast of at most SLOTS slot numbers, so its size is bounded
    at any scale; where the keys fill all slots, nothing is removed."""
    return parted(rows, keys, key)[0]


def parted(rows: DataFrame, keys: DataFrame, key: str = "th") -> tuple[DataFrame, DataFrame]:
    """``rows`` as ``thinned`` leaves them, and the others: those whose key is surely not in ``keys``."""
    slot = F.pmod(F.col(key), F.lit(SLOTS)).cast("int")
    slots = F.broadcast(materialise(keys.select(slot.alias("slot")).distinct(), "slots"))
    return tuple(rows.join(slots, slot == F.col("slot"), kind) for kind in ("left_semi", "left_anti"))


ROWS_AT_ONCE = 1000


def sliced(batches):
    """Arrow batches of ROWS_AT_ONCE rows at most: what a task holds beside them follows their size."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(at, ROWS_AT_ONCE)


class LRU(OrderedDict):
    def __init__(self, limit: int):
        super().__init__()
        self._limit = limit

    def fetch(self, key, make):
        if key in self:
            self.move_to_end(key)
            return self[key]
        while len(self) >= self._limit:
            self.popitem(last=False)
        v = self[key] = make()
        return v
