"""Removal of repeated byte strings by a difference-cover suffix sort.

Every byte covered by a ``limit``-byte string that also starts somewhere else,
in the same or another document, is removed. Strings never cross documents and
are judged on the input.

A full suffix array of the corpus would hold every byte position several times.
Only positions whose ``limit``-byte prefix can be repeated matter, so the text
is reduced first, by conditions that every repeated string meets:

1. Equal texts are one text; from ``limit`` bytes on, copies are removed whole.
2. Anchors. Each window of ``limit`` bytes is assigned the byte position in it
   whose 32-byte hash is smallest (the last one of ties). Equal windows have
   equal anchors at equal offsets. An anchor stays if the bytes before or after
   it, as far as every window on that side of it holds them, occur twice.
3. Classes. The window offsets of an anchor fall into classes of ``STEP``; the
   bytes common to a class's windows (its core) must occur twice. Windows of
   one class that are equal as a whole (its context) are collapsed to a single
   representative with a count: they are repeated. Classes whose contexts all
   have copies are settled.

What is left, the borders of repeats, is sorted by the difference-cover
algorithm modulo 3. Positions count from the anchor, so equal strings have equal
residues. Sampled suffixes are those 1 and 2 modulo 3 bytes before it. Their first limit - 1 bytes are cut into characters of ``CHAR`` bytes, coded by
64-bit hashes; triples of characters are sorted and named by their place in the
order, and names are combined in triples again until one name, the rank, spans
the prefix. The remaining suffixes, 0 modulo 3, follow from their first byte
and the rank of the next (sampled) suffix. Suffixes that are adjacent in this
order are compared: equal prefixes of ``limit`` bytes are repeats.

Strings are identified by 64-bit hashes of several parts (three parts at least
for a window); texts by 64 bits and their length.

Edge cases: null and empty texts and texts below ``limit`` bytes lose nothing
(a shorter text can't hold such a string); equal ids are told apart by their
text; a row repeated with id and text is a copy like any other; an empty table
gives an empty result; other columns are not read; long texts are scanned in
segments, whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import U64, materialise, mix64, prepare, table, thinned

LIMIT = 400
GRAM = 32
STEP = 16
CHAR = 135
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 20
_LOW = (1 << 21) - 1

_POWERS: dict = {}


def _powers(n: int):
    """Powers of the base and of its inverse modulo 2^64, up to n."""
    if _POWERS.get("n", -1) < n:
        size = max(n + 1, 1 << 16)
        for name, b in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, U64(b), np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
        _POWERS["n"] = size - 1
    return _POWERS["up"], _POWERS["down"]


class Hashed:
    """Hash of any slice of a byte string in constant time."""

    def __init__(self, raw: bytes):
        x = np.frombuffer(raw, np.uint8)
        self.n = len(x)
        up, self.down = _powers(self.n)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + U64(1)) * up[:self.n], out=self.sums[1:])
        self.raw = x

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self.down[start])


def _window_minima(v: np.ndarray, w: int) -> np.ndarray:
    n = len(v)
    m = -(-n // w) * w
    p = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    p[:n] = v
    b = p.reshape(-1, w)
    after = np.minimum.accumulate(b, 1).ravel()
    before = np.minimum.accumulate(b[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(before[:n - w + 1], after[w - 1:n])


def anchors(h: Hashed, limit: int = LIMIT, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of every run of windows with one anchor."""
    out = []
    windows = h.n - limit + 1
    w = limit - gram + 1
    for base in range(0, max(0, windows), _SEGMENT):
        count = min(_SEGMENT, windows - base)
        at = np.arange(base, base + count + w - 1)
        v = h.of(at, at + gram) & ~U64(_LOW) | (U64(_LOW) - (at - base).astype(np.uint64))
        low = _window_minima(v, w)
        a = base + _LOW - (low & U64(_LOW)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        out.append((a[first], base + first, base + np.append(first[1:] - 1, count - 1)))
    if not out:
        e = np.zeros(0, np.int64)
        return e, e, e
    return tuple(np.concatenate(x) for x in zip(*out))


def anchor_keys(h: Hashed, a, lo, hi, limit=LIMIT, gram=GRAM):
    """(anchor index, side, key): for windows that start near the anchor the bytes
    after it, for the others the bytes before it, as far as all of them reach."""
    half = (limit - gram) // 2
    near = np.flatnonzero(a - hi < half)                     # some window starts less than half before
    far = np.flatnonzero(a - lo >= half)
    right = h.of(a[near], a[near] + limit - half + 1)
    left = h.of(a[far] - half, a[far] + gram)
    return (np.concatenate((near, far)), np.concatenate((np.zeros(len(near), np.int8), np.ones(len(far), np.int8))),
            np.concatenate((right, left)))


def classes(h: Hashed, a, lo, hi, limit=LIMIT, step=STEP):
    """(anchor index, class, first window, windows, core, context) for each class
    of window offsets of the given anchors."""
    first, last = (a - hi) // step, (a - lo) // step
    k = last - first + 1
    i = np.repeat(np.arange(len(a)), k)
    c = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
    big = np.minimum((c + 1) * step - 1, (a - lo)[i])        # offsets of the class's windows
    small = np.maximum(c * step, (a - hi)[i])
    start = a[i] - big
    # what all windows of the class hold, also those that this text is too short for
    core = h.of(a[i] - c * step, a[i] - (c + 1) * step + 1 + limit)
    context = mix64(h.of(start, a[i] - small + limit) ^ mix64((big * 1024 + small).astype(np.uint64)))
    return i, c, start, big - small + 1, core, context


def _arrow(names: list[str], kinds: list, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip(columns, kinds)], names=names)


def _ints(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64)


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _anchor_rows(texts: DataFrame, limit: int) -> DataFrame:
    names, kinds = ["th", "a", "side", "key"], [pa.int64(), pa.int64(), pa.int8(), pa.int64()]

    def run(batches):
        from shelfcast.llm import suffix_dedup as S
        for b in batches:
            parts, seen = [], set()
            for th, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = S._bytes(t)
                if len(raw) < limit or th in seen:
                    continue
                seen.add(th)
                h = S.Hashed(raw)
                a, lo, hi = S.anchors(h, limit, min(S.GRAM, limit))
                i, side, key = S.anchor_keys(h, a, lo, hi, limit, min(S.GRAM, limit))
                parts.append((np.full(len(i), th, np.int64), a[i], side, S._ints(key)))
            if parts:
                yield S._arrow(names, kinds, [np.concatenate(c) for c in zip(*parts)])

    return texts.mapInArrow(run, "th bigint, a bigint, side tinyint, key bigint")


def _class_rows(alive: DataFrame, limit: int, step: int) -> DataFrame:
    names = ["th", "a", "c", "start", "windows", "core", "context"]
    kinds = [pa.int64()] * 7

    def run(batches):
        from shelfcast.llm import suffix_dedup as S
        for b in batches:
            parts = []
            for th, t, wanted in zip(*(b.column(i).to_pylist() for i in range(3))):
                h = S.Hashed(S._bytes(t))
                a, lo, hi = S.anchors(h, limit, min(S.GRAM, limit))
                keep = np.isin(a, wanted)
                i, c, start, windows, core, context = S.classes(h, a[keep], lo[keep], hi[keep], limit, step)
                parts.append((np.full(len(i), th, np.int64), a[keep][i], c, start, windows, S._ints(core), S._ints(context)))
            if parts:
                yield S._arrow(names, kinds, [np.concatenate(c) for c in zip(*parts)])

    return alive.mapInArrow(run, "th bigint, a bigint, c bigint, start bigint, windows bigint, core bigint, context bigint")


def _suffix_rows(borders: DataFrame, limit: int, char: int) -> DataFrame:
    """One row a window: position, count, whether it is sampled, the byte that the
    rank doesn't span, the characters of the suffix that is ranked."""
    names = ["th", "at", "copies", "sampled", "byte", "chars"]

    def run(batches):
        from shelfcast.llm import suffix_dedup as S
        for b in batches:
            parts = []
            for th, t, jobs in zip(*(b.column(i).to_pylist() for i in range(3))):
                h = S.Hashed(S._bytes(t))
                at = np.concatenate([np.arange(j["start"], j["start"] + j["windows"]) for j in jobs])
                copies = np.concatenate([np.full(j["windows"], j["copies"]) for j in jobs])
                sampled = (np.concatenate([np.full(j["windows"], j["a"]) for j in jobs]) - at) % 3 != 0
                byte = h.raw[np.where(sampled, at + limit - 1, at)].astype(np.int32)
                p = np.where(sampled, at, at + 1)              # the suffix that is ranked, limit - 1 bytes of it
                cuts = np.arange(0, limit - 1, char)
                chars = np.stack([h.of(p + k, p + min(k + char, limit - 1)) for k in cuts], 1)
                parts.append((np.full(len(at), th, np.int64), at, copies, sampled, byte, S._ints(chars)))
            if parts:
                cols = [np.concatenate(c) for c in zip(*parts)]
                chars = cols.pop()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(chars) + 1, dtype=np.int32) * chars.shape[1], pa.int32()),
                                                 pa.array(chars.ravel(), pa.int64()))
                yield S._arrow(names, [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), None], [*cols, lists])

    return borders.mapInArrow(run, "th bigint, at bigint, copies bigint, sampled boolean, byte int, chars array<bigint>")


def rank_by_triples(rows: DataFrame, width: int) -> DataFrame:
    """``chars`` (``width`` characters or names a row) to ``rank``: triples are
    sorted and named by their place, then the names are taken as characters,
    until one is left."""
    while True:
        third = -(-width // 3)
        at = lambda j, k: (F.element_at("chars", 3 * j + k + 1) if 3 * j + k < width else F.lit(0).cast("long"))
        triples = F.array(*[F.struct(at(j, 0).alias("x"), at(j, 1).alias("y"), at(j, 2).alias("z")) for j in range(third)])
        if third == 1:
            t = rows.select("*", at(0, 0).alias("x"), at(0, 1).alias("y"), at(0, 2).alias("z"))
        else:
            t = rows.select("*", F.posexplode(triples).alias("j", "t")).select("*", "t.*").drop("t")
        # sorted as a whole: the number of a row is its place in the order
        names = materialise(t.select("x", "y", "z").distinct().orderBy("x", "y", "z")
                            .withColumn("name", F.monotonically_increasing_id()), "suffix-names")
        named = t.join(names, ["x", "y", "z"]).drop("x", "y", "z")
        if third == 1:
            return named.withColumnRenamed("name", "rank").drop("chars")
        key = [c for c in rows.columns if c != "chars"]
        rows = materialise(named.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "name"))),
                                                               lambda s: s["name"]).alias("chars")), "suffix-level")
        width = third


def repeated_spans(docs: DataFrame, id_col="doc_id", text_col="text", limit=LIMIT, step=STEP, char=CHAR):
    """(alive, spans): (th, text) of the texts that may hold repeats, and (th,
    start, stop) of byte ranges that consist of repeated strings, unmerged."""
    prepare(docs.sparkSession)
    th, text = F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t")
    first, last = F.min(F.struct("th", "a")).alias("p"), F.max(F.struct("th", "a")).alias("q")

    marks = materialise(_anchor_rows(docs.filter(F.octet_length(text_col) >= limit).select(th, text), limit), "suffix-anchors")
    twice = materialise(marks.groupBy("side", "key").agg(first, last).filter("p <> q").select("side", "key"), "suffix-twice")
    wanted = materialise(marks.join(twice, ["side", "key"], "left_semi").groupBy("th").agg(F.collect_set("a").alias("wanted")), "suffix-wanted")
    # one document of each text that holds such an anchor
    one = docs.select(F.col(id_col).alias("i"), th).groupBy("th").agg(F.min("i").alias("i")).join(wanted, "th").alias("o")
    d = thinned(docs.select(F.col(id_col).alias("i"), th, text), wanted).alias("d")
    alive = d.join(one, (F.col("d.th") == F.col("o.th")) & F.col("d.i").eqNullSafe(F.col("o.i"))).select("d.th", "d.t", "o.wanted")
    alive = materialise(alive.dropDuplicates(["th"]), "suffix-alive")

    rows = materialise(_class_rows(alive, limit, step), "suffix-classes")
    pair = ["c", "core"]
    cores = materialise(rows.groupBy(*pair).agg(first, last).filter("p <> q").select(*pair), "suffix-cores")
    kept = materialise(rows.join(cores, pair, "left_semi"), "suffix-kept")
    groups = materialise(kept.groupBy(*pair, "context").agg(F.count("*").alias("copies"),
                                                            F.min(F.struct("th", "start", "windows", "a")).alias("one")), "suffix-contexts")
    equal = kept.join(groups.filter("copies > 1").select(*pair, "context"), [*pair, "context"], "left_semi").select(
        "th", "start", (F.col("start") + F.col("windows") - 1 + limit).alias("stop"))
    open_cores = groups.groupBy(*pair).agg(F.min("copies").alias("least"), F.count("*").alias("contexts")) \
        .filter("least = 1 and contexts > 1").select(*pair)
    borders = (groups.join(open_cores, pair, "left_semi").select("one.*", "copies")
               .groupBy("th").agg(F.collect_list(F.struct("start", "windows", "copies", "a")).alias("jobs")))
    borders = alive.select("th", "t").join(borders, "th")

    suffixes = materialise(_suffix_rows(borders, limit, char), "suffix-rows")
    ranked = rank_by_triples(suffixes, -(-(limit - 1) // char))
    # adjacent suffixes of one residue class: equal rank and byte is an equal prefix of limit bytes
    beside = Window.partitionBy("sampled", "rank", "byte")
    same = ranked.withColumn("n", F.sum("copies").over(beside)).filter("n > 1 and copies = 1").select(
        "th", F.col("at").alias("start"), (F.col("at") + limit).alias("stop"))
    return alive.select("th", "t"), equal.union(same)


def merge_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


_PER_TEXT = "th bigint, n_removed bigint, spans array<struct<start:bigint,stop:bigint>>, kept_sha256 string, kept binary"


def dedup_strings(docs: DataFrame, id_col="doc_id", text_col="text", limit=LIMIT, step=STEP, char=CHAR, with_kept=True) -> DataFrame:
    """Per document: id, n_bytes, n_removed, spans (maximal removed byte ranges),
    kept_sha256 and, if asked for, kept (the remaining bytes)."""
    alive, spans = repeated_spans(docs, id_col, text_col, limit, step, char)
    jobs = spans.groupBy("th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        from shelfcast.llm import suffix_dedup as S
        for b in batches:
            out = []
            for th, t, found in zip(*(b.column(i).to_pylist() for i in range(3))):
                raw = S._bytes(t)
                merged = S.merge_spans((x["start"], x["stop"]) for x in found)
                at, keep = 0, []
                for a, z in merged:
                    keep.append(raw[at:a])
                    at = z
                kept = b"".join(keep) + raw[at:]
                out.append((th, len(raw) - len(kept), [{"start": a, "stop": z} for a, z in merged],
                            hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            if out:
                yield S._arrow(["th", "n_removed", "spans", "kept_sha256", "kept"],
                               [pa.int64(), pa.int64(), kind, pa.string(), pa.binary()], list(zip(*out)))

    per_text = materialise(alive.join(jobs, "th").mapInArrow(run, _PER_TEXT), "suffix-texts")
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("th"), F.octet_length(text).cast("long").alias("n_bytes"),
                    F.sha2(text, 256).alias("own_sha256"), *([text.cast("binary").alias("own")] if with_kept else []))
    # copies of a whole text: all of it is repeated
    copies = materialise(d.filter(F.col("n_bytes") >= limit).groupBy("th").agg(F.count("*").alias("copies"))
                         .filter("copies > 1"), "suffix-copies")
    d = d.join(copies, "th", "left").join(per_text, "th", "left")
    whole = F.col("copies").isNotNull()
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    out = [F.col("i").alias(id_col), "n_bytes",
           F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
           F.when(whole, all_of_it).otherwise(F.coalesce("spans", none)).alias("spans"),
           F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "own_sha256")).alias("kept_sha256")]
    if with_kept:
        out.append(F.when(whole, F.lit(b"")).otherwise(F.coalesce("kept", "own")).alias("kept"))
    return d.select(out)


def op1_suffix_dedup(spark, sf_dir):
    r = dedup_strings(table(spark, sf_dir, "documents"), with_kept=False)
    return r.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
