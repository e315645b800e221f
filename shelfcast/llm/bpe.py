"""Byte-level BPE encoding and decoding.

Pre-tokenisation runs on arrays of code points, without a regular expression.
Each code point gets a class (letter, number, space, other white space, other,
apostrophe that may open a contraction) refined by what follows it. A class is
a function on the eight states of the pattern's automaton; functions compose
associatively, so the state before every code point comes from a blocked scan:
compose the functions inside blocks (all blocks at once), scan the block
functions by doubling, then replay the blocks from their entry states. A new
piece starts where (state, class) says so. The pieces, slices of the UTF-8
bytes, go through pair merging by rank, remembered per distinct piece.

Byte offsets of the tokens are retained; decoding copies the token bytes to
their offsets in one gather.

The pattern is the one of the 50k byte-level vocabularies:
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

Edge cases: null and empty texts have no tokens and decode to empty bytes;
long texts are processed whole, several documents at a time up to
``CHUNK_CHARS`` code points (a longer text is a chunk of its own); ids may
repeat or be null; further columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfcast.llm.common import prepare, table

CHUNK_CHARS = 1 << 20
CACHE_PIECES = 250_000
BLOCK = 64

# states: 0 closed, 1 letters, 2 numbers, 3 others, 4 white space, 5 a space that
# joins what follows, 6 / 7 one / two letters of a contraction to come
# symbols, refined by the next code point:
LETTER, NUMBER, OTHER, APOS1, APOS2, SPACE_IN, SPACE_JOIN, WHITE_IN, WHITE_LAST = range(9)
_STATES = 8


def _step(state: int, sym: int) -> tuple[int, bool]:
    """(next state, whether a piece starts at this symbol)."""
    if sym == LETTER:
        if state in (6, 7):
            return (0 if state == 6 else 6), False
        return 1, state not in (1, 5)
    if sym == NUMBER:
        return 2, state not in (2, 5)
    if sym in (OTHER, APOS1, APOS2):
        if state in (3, 5):
            return 3, False
        return {OTHER: 3, APOS1: 6, APOS2: 7}[sym], True
    if sym in (SPACE_IN, WHITE_IN):
        return 4, state != 4
    return (5 if sym == SPACE_JOIN else 0), True


# second half of the symbols: the same at the start of a document
_NEXT = np.array([[_step(s, c)[0] for s in range(_STATES)] for c in range(9)]
                 + [[_step(0, c)[0]] * _STATES for c in range(9)], np.uint8)
_STARTS = np.array([[_step(s, c)[1] for s in range(_STATES)] for c in range(9)] + [[True] * _STATES] * 9, bool)

#: Code points with the White_Space property.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_LOADED: dict = {}


def _classes() -> np.ndarray:
    """Symbol of a code point before what follows refines it."""
    if "classes" not in _LOADED:
        kind = {"L": LETTER, "N": NUMBER}
        t = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)),
                        np.uint8, sys.maxunicode + 1)
        t[_WHITE] = WHITE_IN
        t[0x20] = SPACE_IN
        _LOADED["classes"] = t
    return _LOADED["classes"]


def symbols(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbol of each code point; ``first``: index of each document's first."""
    n = len(cp)
    sym = np.empty(n + 1, np.uint8)
    np.take(_classes(), cp, out=sym[:n])
    sym[n] = WHITE_IN
    white = sym >= SPACE_IN
    white[first] = True                                   # what follows a document's last
    white[n] = True
    at = np.flatnonzero(sym[:n] >= SPACE_IN)
    sym[at[~white[at + 1]]] += 1                          # a non-space of the document follows
    ap = np.flatnonzero(cp == 0x27)
    if len(ap):
        ends = np.zeros(n + 3, bool)
        ends[first] = True
        ends[n:] = True
        pad = np.append(cp, [0, 0, 0])
        a = np.where(ends[ap + 1], 0, pad[ap + 1])
        b = np.where(ends[ap + 1] | ends[ap + 2], 0, pad[ap + 2])
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        sym[ap[one]] = APOS1
        sym[ap[two]] = APOS2
    sym[first] += 9
    return sym[:n]


def piece_starts(sym: np.ndarray) -> np.ndarray:
    """Indices at which pieces start: an associative scan over the symbols'
    transition functions."""
    n = len(sym)
    m = -(-n // BLOCK)
    s = np.zeros(m * BLOCK, np.intp)
    s[:n] = sym
    s = s.reshape(m, BLOCK).T.copy() * _STATES              # BLOCK x m
    flat = _NEXT.ravel()
    f = np.tile(np.arange(_STATES, dtype=np.uint8), (m, 1))  # each block's function
    for j in range(BLOCK):
        f = flat[s[j][:, None] + f]
    d = 1
    while d < m:                                             # inclusive scan over blocks
        f[d:] = np.take_along_axis(f[d:].copy(), f[:-d].astype(np.intp), 1)
        d *= 2
    state = np.zeros(m, np.uint8)
    state[1:] = f[:-1, 0]
    starts = np.empty((BLOCK, m), bool)
    begins = _STARTS.ravel()
    for j in range(BLOCK):
        at = s[j] + state
        starts[j] = begins[at]
        state = flat[at]
    return np.flatnonzero(starts.T.ravel()[:n])


class _Pieces(dict):
    """Token ids by piece, up to CACHE_PIECES pieces at a time."""

    def __init__(self, vocab):
        super().__init__()
        self._vocab = vocab

    def __missing__(self, piece):
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = self[piece] = self._vocab.merge(piece)
        return ids


class Vocabulary:
    """Ranks of a byte-level vocabulary file (base64 token and rank a line)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for t, r in self.ranks.items():
            tokens[r] = t
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.decimal = [str(i).encode() for i in range(size)]
        ranks = self.ranks
        self.pairs = {(ranks[t[:i]] << 20) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t))
                      if t[:i] in ranks and t[i:] in ranks}
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.cache = _Pieces(self)

    def merge(self, piece: bytes) -> tuple:
        """Token ids of a piece: the pair of lowest rank merges first. A pair's
        rank is the id of the merged token."""
        got = self.ranks.get(piece)
        if got is not None:
            return (got,)
        if len(piece) >= 100:
            return self.merge_long(piece)
        get, far = self.pairs.get, 1 << 40
        single = self.single
        parts = [single[c] for c in piece]
        pairs = [get((a << 20) | b, far) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == far:
                break
            i = pairs.index(low)
            parts[i] = low
            del parts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get((parts[i - 1] << 20) | low, far)
            if i < len(pairs):
                pairs[i] = get((low << 20) | parts[i + 1], far)
        return tuple(parts)

    def merge_long(self, piece: bytes) -> tuple:
        """The same for long pieces, with a heap over linked parts."""
        import heapq
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))          # part i is piece[i:end[i]]; -1: merged away
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if j < 0 or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, -1
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(token ids, byte offsets with the end) of each text; one chunk."""
        out = [(np.zeros(0, np.int32), np.zeros(1, np.int64))] * len(texts)
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return out
        joined = "".join([texts[i] for i in full])
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        first = np.concatenate(([0], np.cumsum([len(texts[i]) for i in full])))
        raw = np.frombuffer(joined.encode("utf-8"), np.uint8)
        starts = piece_starts(symbols(cp, first[:-1]))
        at = starts                                        # as byte offsets
        if len(raw) > len(cp):
            wide = (cp >= 0x80).view(np.uint8) + (cp >= 0x800).view(np.uint8) + (cp >= 0x10000).view(np.uint8)
            at = starts + np.cumsum(wide, dtype=np.int64)[starts] - wide[starts]
        doc = np.searchsorted(starts, first)
        ids = list(map(self.cache.__getitem__, np.insert(raw, at[1:], 0xFF).tobytes().split(b"\xff")))
        for k, i in enumerate(full):
            a = np.fromiter(chain.from_iterable(ids[doc[k]:doc[k + 1]]), np.int32)
            out[i] = (a, np.concatenate(([0], np.cumsum(self.lengths[a]))))
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Bytes of a run of tokens: each token's bytes go to its offset."""
        if len(ids) == 0:
            return b""
        n = np.diff(offsets)
        source = np.repeat(self.starts[ids] - (offsets[:-1] - offsets[0]), n)
        return self.bytes[source + np.arange(int(offsets[-1] - offsets[0]))].tobytes()


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _chunks(texts: list) -> list[list]:
    out, n = [[]], 0
    for t in texts:
        if out[-1] and n + len(t or "") > CHUNK_CHARS:
            out.append([])
            n = 0
        out[-1].append(t or "")
        n += len(t or "")
    return out


def encode_texts(texts: list, path: str):
    v = vocabulary(path)
    for c in _chunks(texts):
        yield from v.encode(c)


def encode(docs: DataFrame, id_col="doc_id", text_col="text", path: str | None = None) -> DataFrame:
    """Per document: id, token ids, byte offset of each token and the end."""
    prepare(docs.sparkSession)
    path = path or default_path()
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)]
                          + T._parse_datatype_string("ids array<int>, offsets array<bigint>").fields)

    def run(batches):
        from shelfcast.llm import bpe
        for b in batches:
            got = list(bpe.encode_texts(b.column(1).to_pylist(), path))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), bpe.as_lists([g[0] for g in got], pa.int32()), bpe.as_lists([g[1] for g in got], pa.int64())],
                names=[f.name for f in schema.fields])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def as_lists(arrays: list[np.ndarray], kind) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, kind))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``ids`` and ``offsets`` of each row to its ``bytes``; other columns stay."""
    prepare(encoded.sparkSession)
    path = path or default_path()
    ai, ao = encoded.columns.index("ids"), encoded.columns.index("offsets")
    rest = [c for c in encoded.columns if c not in ("ids", "offsets")]
    schema = T.StructType([encoded.schema[c] for c in rest] + [T.StructField("bytes", T.BinaryType())])

    def run(batches):
        import numpy as np
        from shelfcast.llm import bpe
        v = bpe.vocabulary(path)
        for b in batches:
            ids, off = b.column(ai), b.column(ao)
            got = [v.decode(np.asarray(i.values, np.int64), np.asarray(o.values, np.int64)) for i, o in zip(ids, off)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in rest] + [pa.array(got, pa.binary())],
                                             names=[f.name for f in schema.fields])

    return encoded.mapInArrow(run, schema)


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, id_col="doc_id", text_col="text", path: str | None = None) -> DataFrame:
    """Encode, decode the ids again, and return digests of both per document;
    one task pass, so that the id arrays needn't leave the worker."""
    prepare(docs.sparkSession)
    path = path or default_path()
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + T._parse_datatype_string(DIGEST).fields)

    def run(batches):
        from shelfcast.llm import bpe
        v = bpe.vocabulary(path)
        for b in batches:
            rows = [bpe.digest(v, ids, off) for ids, off in bpe.encode_texts(b.column(1).to_pylist(), path)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.string())], names=[f.name for f in schema.fields])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def digest(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[int, str, str]:
    text = b" ".join(map(v.decimal.__getitem__, ids.tolist()))
    return len(ids), hashlib.sha256(text).hexdigest(), hashlib.sha256(v.decode(ids, offsets)).hexdigest()


def op10_byte_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))
