"""Benchmark decontamination by a generalised suffix automaton.

The normalised test items are held in blocks of at most ``block_words`` words.
One automaton per block recognises every run of item words. A task streams the
words of its documents through the automaton, keeps the longest matching length
at every position, and marks the windows that end there: ``window`` consecutive
words of one item, or a whole item that is shorter. Documents are never
shuffled; only the item blocks travel, each of a bounded size.

Before the automaton runs, a table of the block's short word runs rules out the
positions at which no window can lie (exact: a window consists of such runs).

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

Edge cases: a null or empty text has no words, no hits and is kept; an item
without words is never found; equal items count each; repeated documents are
judged each on its own; an empty benchmark leaves every document as it is;
other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.llm.common import LRU, U64, mix64, prepare

WINDOW = 13
COVERAGE = 20          # contaminated when COVERAGE * hit words >= all words
BLOCK_WORDS = 200_000  # most words of one broadcast block

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
               else 32 for b in range(256))
_FILTER_BITS = 22

RESULT = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,stop:int>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class SuffixAutomaton:
    """Of several word sequences; matches never run from one into the next."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words in items:
            if words:
                ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
                coded.append((item, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self.windows: dict[int, set[str]] = {}       # state of a window's length -> items
        self.whole: dict[int, list[tuple[int, str]]] = {}  # state of a short item -> (length, item)
        for item, ids in coded:
            v = 0
            for i, c in enumerate(ids):
                v = self.next[v][c]
                if i + 1 >= window:
                    self.windows.setdefault(self._cut(v), set()).add(item)
            if len(ids) < window:
                self.whole.setdefault(v, []).append((len(ids), item))
        self.up = self._nearest_short()
        lengths = [min(len(ids), window) for _, ids in coded]
        self.least = min(lengths, default=0)
        self.gram = min(3, self.least)
        self.table = np.zeros(1 << _FILTER_BITS, bool)
        for _, ids in coded:
            self.table[self._grams(np.asarray(ids, np.int64))] = True

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        k = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = k
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        return k

    def _cut(self, v: int) -> int:
        """The state of the last ``window`` words of a longer match at ``v``."""
        while self.length[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def _nearest_short(self) -> list[int]:
        """For each state, itself or the nearest suffix state that ends a short item."""
        up = [-1] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up[v] = v if v in self.whole else up[self.link[v]]
        return up

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - self.gram + 1
        if n <= 0 or self.gram == 0:
            return np.zeros(0, np.int64)
        h = np.zeros(n, np.uint64)
        for k in range(self.gram):
            h = h * U64(0x9E3779B97F4A7C15) + ids[k:k + n].astype(np.uint64) + U64(1)
        return (mix64(h) >> U64(64 - _FILTER_BITS)).astype(np.int64)

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words in which a window may lie; all windows lie in one."""
        if self.least == 0 or len(ids) < self.least:
            return []
        g = self.gram
        ok = self.table[self._grams(ids)]
        bad = (ids < 0).astype(np.int64)
        ok &= np.convolve(bad, np.ones(g, np.int64), "valid") == 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
        return [(int(a), int(b) + g - 1) for a, b in zip(edge[::2], edge[1::2]) if b - a >= self.least - g + 1]

    def scan(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit stretches (word positions) and the items whose windows occur."""
        hits: list[tuple[int, int]] = []
        items: set[str] = set()
        w = self.window
        for a, b in self.candidates(ids):
            v = matched = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while v and c not in self.next[v]:
                    v = self.link[v]
                    matched = self.length[v]
                if c in self.next[v]:
                    v = self.next[v][c]
                    matched += 1
                if matched >= w:
                    hits.append((i + 1 - w, i + 1))
                    items |= self.windows[self._cut(v)]
                s = self.up[v]
                while s >= 0:
                    for n, item in self.whole.get(s, ()):
                        if n <= matched:
                            hits.append((i + 1 - n, i + 1))
                            items.add(item)
                    s = self.up[self.link[s]] if self.link[s] > 0 else -1
        return hits, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_AUTOMATA = LRU(2)


def judge(text: str | None, automata) -> tuple[int, int, list[str], list[tuple[int, int]]]:
    """(words, hit words, sorted item ids, hit spans as word positions) of one text."""
    words = words_of(text)
    hits, items = [], set()
    for auto in automata:
        get = auto.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        h, i = auto.scan(ids)
        hits += h
        items |= i
    spans = merged(hits)
    return len(words), sum(b - a for a, b in spans), sorted(items), spans


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word positions to code points."""
    at = [m.span() for m in _WORD.finditer(re.sub("[A-Z]+", lambda m: m[0].lower(), text))]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def benchmark_blocks(benchmark: DataFrame, item_col="item_id", text_col="text", block_words=BLOCK_WORDS) -> list:
    """Broadcast blocks of at most ``block_words`` words (one longer item makes a
    block of its own); the driver holds one block at a time."""
    spark = benchmark.sparkSession
    blocks, block, n = [], [], 0
    for r in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).toLocalIterator():
        words = words_of(r[1])
        if block and n + len(words) > block_words:
            blocks.append((uuid.uuid4().hex, spark.sparkContext.broadcast(block)))
            block, n = [], 0
        block.append((r[0] or "", words))
        n += len(words)
    if block:
        blocks.append((uuid.uuid4().hex, spark.sparkContext.broadcast(block)))
    return blocks


def _automata(blocks, window):
    for name, b in blocks:
        yield _AUTOMATA.fetch((name, window), lambda b=b: SuffixAutomaton(b.value, window))


def _judged(texts, blocks, window):
    """Results of a batch, one block at a time."""
    if len(blocks) <= _AUTOMATA._limit:
        autos = list(_automata(blocks, window))
        return [judge(t, autos) for t in texts]
    parts = [[] for _ in texts]
    for auto in _automata(blocks, window):
        for i, t in enumerate(texts):
            parts[i].append(judge(t, [auto]))
    out = []
    for p in parts:
        spans = merged([s for _, _, _, sp in p for s in sp])
        out.append((p[0][0], sum(b - a for a, b in spans), sorted({x for _, _, it, _ in p for x in it}), spans))
    return out


def annotate(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", window=WINDOW,
             block_words=BLOCK_WORDS) -> DataFrame:
    """Per document: id, n_words, n_hit, item_ids (sorted strings), spans of hit
    text in code points. No shuffle."""
    prepare(docs.sparkSession)
    blocks = benchmark_blocks(benchmark, text_col="text", block_words=block_words)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type)] + T._parse_datatype_string(RESULT).fields)

    def run(batches):
        from shelfcast.llm import decontaminate as D
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = D._judged(texts, blocks, window)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.list_(pa.string())),
                pa.array([[{"start": a, "stop": z} for a, z in D.char_spans(t, r[3])] if r[3] else []
                          for t, r in zip(texts, rows)],
                         pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))],
                names=[f.name for f in schema.fields])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col="text", window=WINDOW, coverage=COVERAGE,
                  max_span_words: int | None = None, block_words=BLOCK_WORDS) -> DataFrame:
    """``docs`` without contaminated documents, columns unchanged.

    A document goes when hit words make up at least 1/``coverage`` of its words.
    In the others every hit stretch of more than ``max_span_words`` words is cut
    out of the text (None: their texts stay as they are)."""
    prepare(docs.sparkSession)
    blocks = benchmark_blocks(benchmark, block_words=block_words)
    at = docs.columns.index(text_col)

    def run(batches):
        from shelfcast.llm import decontaminate as D
        for b in batches:
            texts = b.column(at).to_pylist()
            rows = D._judged(texts, blocks, window)
            keep = [not (r[1] > 0 and coverage * r[1] >= r[0]) for r in rows]
            if max_span_words is not None:
                long = [[s for s in r[3] if s[1] - s[0] > max_span_words] for r in rows]
                texts = [D.cut(t, D.char_spans(t, s)) if s else t for t, s in zip(texts, long)]
                cols = list(b.columns)
                cols[at] = pa.array(texts, b.schema.field(at).type)
                b = pa.RecordBatch.from_arrays(cols, schema=b.schema)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join(out) + text[at:]


def op2_decontaminate(spark, sf_dir):
    from shelfcast.llm.common import table
    r = annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                    F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                    ((F.col("n_hit") > 0) & (COVERAGE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
