"""Substring dedup over fixed-length windows of words, by Rabin-Karp hashes.

A window is ``length`` consecutive words (cut at ASCII white space, unchanged) of
one document. A window is removed from a document if the same words also start
in a document with a smaller id; what removed windows cover merges into maximal
intervals. Windows are judged on the input, not on what is left.

1. Every text's word hashes give the rolling (Rabin-Karp) hash of each window and
   of each run of SEED words. The least seed hash inside a window is its group:
   equal windows have equal groups, wherever they are, so a window whose group is
   in one document only cannot repeat. Groups are counted in Spark (least and
   largest id, partial sums in the tasks); about one word in sixteen gives one.
2. The windows of groups found in several documents are counted in Spark by
   (group, hash), which is 128 bits, to the least id that holds them.
3. Windows with a smaller holder go back to their documents by a join on
   (group, hash), and their positions merge into intervals.

A window that a third of the documents share is one row per task in the counts
and a key that Spark may split in the joins, which meet written tables on both
sides. Texts are hashed about a megabyte at a time, whole, never a prefix.

Edge cases: a null text has no words; texts of fewer than ``length`` words stay
whole; ids are integers, a null id counts as -2^63; rows equal in id never remove
each other's words, and rows equal in id and text have equal results; an empty
table gives an empty result; other columns pass through, whatever their names (the
added column gets underscores until its name is free).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.llm.common import _SPACE, _powers, U64, discard, materialise, mix64, prepare, table

LENGTH = 50
SEED = 20
CHUNK = 1 << 20
NO_ID = -(1 << 63)

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_GAP = re.compile(rb"[\x20\x09-\x0d]")
_table = {}


# ---- hashes of words and windows (numpy, per task) ----

def _chain(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    p = _table.get(base)
    if p is None or len(p) < n:
        p = np.full(max(n, 1 << 12), U64(base), np.uint64)
        p[0] = 1
        p = _table[base] = np.cumprod(p)
    return p[:n]


def _hashed(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts one after another, and each text's number of words."""
    x = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    space = _SPACE[x]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    size = np.array([len(b) + 1 for b in raw])
    first = np.searchsorted(starts, np.append(1, 1 + np.cumsum(size)))
    if not len(starts):
        return np.zeros(0, np.uint64), np.diff(first)
    lead = np.append(0, starts)
    at = np.arange(len(x)) - np.repeat(lead, np.diff(np.append(lead, len(x))))
    at[space] = 0
    value = (x.astype(np.uint64) + U64(1)) * _powers(int(at.max()) + 1)[at]
    value[space] = 0
    return mix64(np.add.reduceat(value, starts)), np.diff(first)


def _pieces(raw: bytes):
    at = 0
    while len(raw) - at > CHUNK:
        m = _GAP.search(raw, at + CHUNK)
        end = m.start() if m else len(raw)
        yield raw[at:end]
        at = end
    yield raw[at:]


def word_hashes(texts: list) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """Chunks (numbers of the texts, their word counts, word hashes of all of them)."""
    group, held = [], 0
    out = []

    def close():
        if group:
            h, n = _hashed([texts[k] for k in group])
            out.append((list(group), n, h))
            group.clear()

    for k, t in enumerate(texts):
        if not t:
            continue
        if len(t) > CHUNK:
            h = np.concatenate([_hashed([p])[0] for p in _pieces(t)])
            out.append(([k], np.array([len(h)]), h))
            continue
        if held + len(t) > CHUNK:
            close()
            held = 0
        group.append(k)
        held += len(t)
    close()
    return out


def rolling(words: np.ndarray, length: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``length`` words, modulo 2^64, from prefix sums."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    s = np.append(U64(0), np.cumsum(words * _chain(_BASE, n)))
    return (s[length:] - s[:-length]) * _chain(_UNBASE, n - length + 1)


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def windows(words: np.ndarray, counts: np.ndarray, length: int, seed: int):
    """(text, start, group) of the windows inside the texts of a chunk, as arrays."""
    groups = least_of(mix64(rolling(words, seed)), length - seed + 1) if len(words) >= length else np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)[:len(groups)]
    start = np.arange(len(groups))
    inside = start + length <= ends[owner]
    return owner[inside], start[inside], groups[inside]


def _binary(col) -> list:
    return pc.cast(col, pa.binary()).to_pylist()


def _long(x: np.ndarray):
    return pa.array(x.view(np.int64), pa.int64())


def _groups(length, seed):
    def run(batches):
        for b in batches:
            ids, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            for who, counts, words in word_hashes(_binary(b.column(2))):
                owner, _, m = windows(words, counts, length, seed)
                if not len(m):
                    continue
                new = np.append(True, (m[1:] != m[:-1]) | (owner[1:] != owner[:-1]))
                row = np.array(who)[owner[new]]
                yield pa.RecordBatch.from_arrays([_long(ids[row]), _long(th[row]), _long(m[new])], ["id", "th", "m"])
    return run


def _candidates(length, seed):
    def run(batches):
        for b in batches:
            ids, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            wanted = b.column(3)
            for who, counts, words in word_hashes(_binary(b.column(2))):
                owner, start, m = windows(words, counts, length, seed)
                if not len(m):
                    continue
                keep = np.zeros(len(m), bool)
                edge = np.searchsorted(owner, np.arange(len(who) + 1))
                for k, (a, z) in enumerate(zip(edge[:-1], edge[1:])):
                    if z > a:
                        keep[a:z] = np.isin(m[a:z].view(np.int64), wanted[who[k]].values.to_numpy())
                if not keep.any():
                    continue
                # mixed again, so that the hash has nothing in common with the group's
                h = rolling(mix64(words ^ U64(0x5851F42D4C957F2D)), length)[start[keep]]
                owner, start, m = owner[keep], start[keep], m[keep]
                new = np.append(True, (m[1:] != m[:-1]) | (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1))
                at = np.flatnonzero(new)
                row = np.array(who)[owner[at]]
                begin = np.cumsum(counts) - counts
                runs = pa.ListArray.from_arrays(pa.array(np.append(at, len(h)), pa.int32()), _long(h))
                yield pa.RecordBatch.from_arrays(
                    [_long(ids[row]), _long(th[row]), pa.array(start[at] - begin[owner[at]], pa.int64()), _long(m[at]), runs],
                    ["id", "th", "at", "m", "hs"])
    return run


# ---- Spark ----

def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_col).alias("th"),
                       F.col(text_col).alias("t"))


def repeated_windows(docs: DataFrame, id_col="doc_id", text_col="text", length=LENGTH, seed=SEED) -> DataFrame:
    """(id, th, starts) of the rows that lose words: the positions, in words, of the windows
    that also start in a document with a smaller id. ``th`` is xxhash64 of the text."""
    prepare(docs.sparkSession)
    d = _keyed(docs, id_col, text_col).filter("t is not null")
    seen = materialise(d.mapInArrow(_groups(length, seed), "id long, th long, m long"), "substring-groups")
    two = [F.min("id").alias("lo"), F.max("id").alias("hi")]
    shared = materialise(seen.groupBy("m").agg(*two).filter("lo < hi").select("m"), "substring-shared")
    wanted = materialise(seen.join(shared, "m").groupBy("id", "th").agg(F.collect_set("m").alias("ms")), "substring-wanted")
    discard(seen)
    discard(shared)
    a, b = d.alias("a"), wanted.alias("b")
    w = materialise(a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.th") == F.col("b.th")))
                    .select("a.id", "a.th", "a.t", "b.ms")
                    .mapInArrow(_candidates(length, seed), "id long, th long, at long, m long, hs array<long>"), "substring-windows")
    discard(wanted)
    each = w.select("id", "th", "at", "m", F.posexplode("hs").alias("p", "h"))
    first = materialise(each.groupBy("m", "h").agg(*two).filter("lo < hi").select("m", "h", "lo"), "substring-first")
    hit = each.join(first, ["m", "h"]).filter("id > lo")
    out = materialise(hit.groupBy("id", "th").agg(F.collect_set((F.col("at") + F.col("p")).cast("int")).alias("starts")), "substring-hits")
    discard(w)
    discard(first)
    return out


_RESULT = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()),
                     ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("text", pa.string())])


def _cut(at, length):
    """Puts the result in the place of the last column, the starts; column ``at`` is the text."""
    def one(raw, s):
        words = raw.split() if raw else []
        spans = []
        if s.is_valid and len(s.values):
            x = np.sort(s.values.to_numpy())
            new = np.append(True, x[1:] > x[:-1] + length)
            first = np.flatnonzero(new)
            spans = list(zip(x[first].tolist(), (x[np.append(first[1:], len(x)) - 1] + length).tolist()))
        kept, last = [], 0
        for a, z in spans:
            kept += words[last:a]
            last = z
        kept += words[last:]
        return {"n_words": len(words), "n_removed": len(words) - len(kept), "spans": [{"first": a, "end": z} for a, z in spans],
                "text": None if raw is None else b" ".join(kept).decode("utf-8", "replace")}

    def run(batches):
        for b in batches:
            out = pa.array([one(raw, s) for raw, s in zip(_binary(b.column(at)), b.columns[-1])], _RESULT)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], b.schema.names)
    return run


def free_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def dedup_substrings(docs: DataFrame, id_col="doc_id", text_col="text", length=LENGTH, seed=SEED) -> DataFrame:
    """``docs`` with a struct column ``substring_dedup``: n_words, n_removed, spans (word
    numbers, end exclusive, maximal), text (kept words joined by one space)."""
    hits = repeated_windows(docs, id_col, text_col, length, seed)
    d, h = docs.alias("d"), hits.alias("h")
    on = (F.coalesce(F.col(f"d.{id_col}").cast("long"), F.lit(NO_ID)) == F.col("h.id")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("h.th"))
    name = free_name(docs, "substring_dedup")
    result = T.StructField(name, T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("text", T.StringType())]))
    return (d.join(h, on, "left").select("d.*", F.col("h.starts").alias(name))
            .mapInArrow(_cut(docs.columns.index(text_col), length), T.StructType([*docs.schema.fields, result])))


def op13_substring_dedup(spark, sf_dir):
    r = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    x = F.col("substring_dedup")
    return r.select("doc_id", x["n_words"].alias("n_words"), x["n_removed"].alias("n_removed"),
                    F.sha2(F.coalesce(x["text"], F.lit("")), 256).alias("kept_sha256"), F.size(x["spans"]).cast("long").alias("n_spans"))
