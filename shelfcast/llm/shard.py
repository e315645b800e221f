"""Sharding by histogram sort.

Rows are ordered by (hash of the text, hash of id and text): equal texts lie
side by side, so a group stays in one shard unless a boundary has to run
through it, and a text that a third of the rows share is divided by the second
part. Splitters are found without moving a row: each round counts the exact
bytes and rows below candidate boundaries across all partitions and refines the
probes (``BITS`` bits at a time) only in the intervals that still hold a
splitter outside its tolerance. Then the rows are exchanged once, by the range
between splitters they fall in, and numbered in key order.

Each shard consists of several ranges, so that numbering needs only small
ordered windows; the rows before each range are known from the histogram. The
driver holds, per round, 2^BITS counts for each open interval: bounded by the
number of splitters, never by the rows.

Law ``bytes``: the sizes of the shards (UTF-8 bytes of the text plus 1 a row)
differ from an equal share by at most TOLERANCE of it or by one key's rows.

Edge cases: a null text counts no bytes and size 1, checksum that of no bytes;
null ids are hashed like any value; rows equal in id and text have equal keys
and lie in one range (slots among them are arbitrary but gapless); an empty
table gives an empty result; further columns pass through; the added columns
are in one struct, ``placement``, so names can't clash.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import materialise, table

SHARDS = 8
TOLERANCE = 0.0005
INNER_TOLERANCE = 0.1
RANGE_ROWS = 200_000   # rows of a range that is numbered by one task, about
MOST_RANGES = 64       # ranges of a shard
BITS = 8

_OFFSET = 1 << 63


def _unsigned(v: int) -> int:
    return v + _OFFSET


def _signed(v: int) -> int:
    return v - _OFFSET


def keyed(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(h, k, size) of every row: the sort key and its bytes."""
    return docs.select(*key_columns(F.col(id_col), F.col(text_col)))


def key_columns(i: Column, t: Column) -> list[Column]:
    return [F.xxhash64(t).alias("h"), F.xxhash64(i, t, F.lit(1)).alias("k"),
            (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size")]


def histogram(keys: DataFrame, opened: list[tuple]) -> dict:
    """Exact bytes and rows of the cells of every open interval, in one job.

    An interval is (h prefix, bits) or (h, k prefix, bits); a cell extends the
    prefix by BITS bits."""
    by_level: dict[tuple, list] = {}
    for o in opened:
        by_level.setdefault((len(o), o[-1]), []).append(o)
    parts = []
    for (n, bits), os in sorted(by_level.items()):
        col = "h" if n == 2 else "k"
        shift = 64 - bits
        prefix = _prefix(col, bits)
        if n == 2:
            here = prefix.isin([o[0] for o in os]) if bits else F.lit(True)
            tag = F.struct(F.lit(n).alias("n"), F.lit(bits).alias("bits"), F.lit(0).cast("long").alias("h"), prefix.alias("p"))
        else:
            hs = sorted({_signed(o[0]) for o in os})
            here = F.col("h").isin(hs)
            if bits:
                here &= prefix.isin(sorted({o[1] for o in os}))
            tag = F.struct(F.lit(n).alias("n"), F.lit(bits).alias("bits"), F.col("h"), prefix.alias("p"))
        cell = F.shiftrightunsigned(F.col(col).bitwiseXOR(F.lit(-_OFFSET).cast("long")), shift - BITS).bitwiseAND((1 << BITS) - 1)
        parts.append(F.when(here, F.struct(tag.alias("tag"), cell.alias("cell"))))
    rows = (keys.select("size", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("c"))
            .groupBy("c").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect())
    out: dict = {}
    for r in rows:
        t = r.c.tag
        o = (t.p, t.bits) if t.n == 2 else (_unsigned(t.h), t.p, t.bits)
        out.setdefault(o, {})[r.c.cell] = (r.bytes, r.rows)
    return out


def _prefix(col: str, bits: int) -> Column:
    """The first bits of the unsigned value."""
    if bits == 0:
        return F.lit(0).cast("long")
    return F.shiftrightunsigned(F.col(col).bitwiseXOR(F.lit(-_OFFSET).cast("long")), 64 - bits)


def find_splitters(keys: DataFrame, targets: list[float], tolerances: list[float]) -> list[tuple]:
    """For each target number of bytes: the boundary key (h, k), unsigned, and
    the exact bytes and rows below it. Non-decreasing."""
    # per target: open interval, bytes and rows before it; start of the interval as a key
    state = [((0, 0), 0, 0)] * len(targets)
    done: list = [None] * len(targets)
    while any(d is None for d in done):
        counts = histogram(keys, sorted({s[0] for s, d in zip(state, done) if d is None}))
        for i, (t, tol) in enumerate(zip(targets, tolerances)):
            if done[i] is not None:
                continue
            o, b, r = state[i]
            cells = counts.get(o, {})
            at = None
            for c in sorted(cells):
                nb, nr = cells[c]
                if b + nb > t:
                    at = (c, nb, nr)
                    break
                b, r = b + nb, r + nr
            if at is None:      # the target lies at the interval's end
                done[i] = (*_end(o), b, r)
                continue
            c, nb, nr = at
            inner = _child(o, c)
            if inner is None and len(o) == 2:   # one text: go on by the second part
                inner = ((o[0] << BITS) | c, 0, 0)
            if t - b <= tol or nr == 1 or inner is None:
                # the boundary before the cell is near enough, or nothing is left to refine
                after = inner is not None and nr == 1 and (b + nb - t) < (t - b)
                if after:
                    done[i] = (*_end(inner), b + nb, r + nr)
                else:
                    done[i] = (*_begin(inner if inner is not None else (o[0], (o[1] << BITS) | c, 64)), b, r)
            elif b + nb - t <= tol:
                done[i] = (*(_end(inner) if inner is not None else _end((o[0], (o[1] << BITS) | c, 64))), b + nb, r + nr)
            else:
                state[i] = (inner, b, r)
    return done


def _child(o: tuple, c: int):
    """The cell as an interval; None if it is a single value."""
    bits = o[-1] + BITS
    if bits >= 64:
        return None
    return ((o[0] << BITS) | c, bits) if len(o) == 2 else (o[0], (o[1] << BITS) | c, bits)


def _begin(o: tuple) -> tuple[int, int]:
    return (o[0] << (64 - o[1]), 0) if len(o) == 2 else (o[0], o[1] << (64 - o[2]))


def _end(o: tuple) -> tuple[int, int]:
    """The first key after the interval."""
    if len(o) == 2:
        return ((o[0] + 1) << (64 - o[1]), 0)
    k = (o[1] + 1) << (64 - o[2])
    return (o[0], k) if k < 1 << 64 else (o[0] + 1, 0)


def plan_shards(keys: DataFrame, shards=SHARDS, tolerance=TOLERANCE, range_rows=RANGE_ROWS) -> list[tuple]:
    """Ranges in key order: (first key h, k as signed values, shard, slot of its first row)."""
    n, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    per = max(1, min(MOST_RANGES, -(-n // (shards * range_rows))))
    targets = [total * i / (shards * per) for i in range(1, shards * per)]
    tols = [total / shards * (tolerance if i % per == 0 else INNER_TOLERANCE / per) for i in range(1, shards * per)]
    cuts = find_splitters(keys, targets, tols) if n else []
    ranges = [(0, 0, 0, 0)]
    shard_rows = 0
    for i, (h, k, _, rows) in enumerate(cuts, 1):
        if i % per == 0:
            shard_rows = rows
        ranges.append((h, k, i // per, rows - shard_rows))
    return ranges


def place(docs: DataFrame, id_col="doc_id", text_col="text", shards=SHARDS, tolerance=TOLERANCE,
          range_rows=RANGE_ROWS) -> DataFrame:
    """``docs`` with a struct ``placement``: size, shard, slot."""
    keys = materialise(keyed(docs, id_col, text_col), "shard-keys")
    ranges = plan_shards(keys, shards, tolerance, range_rows)
    h, k, size = key_columns(F.col(id_col), F.col(text_col))
    d = docs.select(F.struct("*").alias("row"), h, k, size)

    def reached(r):
        if r[0] >= 1 << 64:
            return F.lit(0)
        a, b = _signed(r[0]), _signed(r[1])
        return ((F.col("h") > a) | (F.col("h") == a) & (F.col("k") >= b)).cast("int")

    at = F.lit(0)
    for r in ranges[1:]:
        at = at + reached(r)
    d = d.withColumn("at", at)
    number = F.row_number().over(Window.partitionBy("at").orderBy("h", "k"))
    first = F.element_at(F.array(*[F.lit(r[3]).cast("long") for r in ranges]), F.col("at") + 1)
    shard = F.element_at(F.array(*[F.lit(r[2]) for r in ranges]), F.col("at") + 1)
    return d.select("row.*", F.struct("size", shard.cast("int").alias("shard"),
                                      (first + number - 1).cast("long").alias("slot")).alias("placement"))


def shard_of(ranges: list[tuple], h: int, k: int) -> int:
    """The shard of a key, on the driver (for tests)."""
    return ranges[bisect_right([(r[0], r[1]) for r in ranges], (_unsigned(h), _unsigned(k))) - 1][2]


def op7_histogram_sort(spark, sf_dir):
    p = place(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return p.select("doc_id", F.col("placement.size").alias("size"),
                    F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"),
                    F.col("placement.shard").alias("shard"), F.col("placement.slot").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"))
