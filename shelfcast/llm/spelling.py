"""Spelling variant grouping by PartEnum signatures.

Words are the runs of letters of all texts, A-Z lower-cased; a documented rule
of the test data (crc32 of document and run) deletes one letter of about every
97th (document, run). Two words are near if one inserted, deleted or replaced
code point turns one into the other. A word's form is its near word of largest
count if that is at least twice the word's own; its root is the end of the
chain of forms.

Near words are found by PartEnum. A word's multiset of letters is a binary
vector over (letter, occurrence). One replaced letter changes the vector in two
places, one inserted or deleted letter in one place. The dimensions are dealt to
PARTS parts; words at distance two agree on at least PARTS - 2 of them, so one
signature per pair of agreeing parts (enumerated) finds them, and for distance
one PARTS is folded to two parts of which one agrees. Every signature also
carries what an edit can't change at the same time: the length of the shorter
word and the half of the word, in order, in which the edit isn't. Signatures
meet in equi-joins; the edit distance is checked inside the join, and a pair is
taken only at the first signature on which its words agree, so no pair appears
twice and no candidate leaves the join.

Counting is an aggregate with partial sums in the tasks. No group of a
signature is ever gathered: the joins are sort-merge joins whose skewed keys
Spark may split. Roots come by pointer jumping; a chain's counts at least
double, so it has at most 63 steps and six rounds end it.

Edge cases: a null or empty text has no words; a null id is written as the empty
string in the rule; rows equal in id and text count as two documents' worth of
words; very long texts are cut between words and counted piece by piece; a table
without words gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import discard, materialise, prepare, table

LEAST_LETTERS = 5
LEAST_COUNT = 3
DIVISOR = 97
PARTS = 4
COMBOS = list(combinations(range(PARTS), 2))
HELD = 200_000          # words a task holds before it hands its partial counts on
PIECE = 1 << 20         # code points of a text that are cut into words at a time

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LETTERS = "enitarohsucldgbfmpwvykjxqz"    # common letters first: spreads them over the parts


# ---- words of the texts ----

def _pieces(text: str):
    """The text in slices that no run of letters crosses."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        m = _RUN.match(text, end)
        end = m.end() if m else end
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def words_of(doc_id: str, raw: bytes) -> Counter:
    """Counts of a text's words after the deletion rule."""
    runs: Counter = Counter()
    for piece in _pieces(raw.lower().decode("utf-8", "replace")):
        runs.update(_RUN.findall(piece))
    start = zlib.crc32(f"{doc_id}:".encode())
    out: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % DIVISOR == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1:]
        if len(run) >= LEAST_LETTERS:
            out[run] += n
    return out


def _count(batches):
    def rows(c):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    held: Counter = Counter()
    for b in batches:
        for i, raw in zip(b.column(0).to_pylist(), pc.cast(b.column(1), pa.binary()).to_pylist()):
            if raw:
                for w, n in words_of(i, raw).items():
                    held[w] += n
            if len(held) > HELD:
                yield rows(held)
                held = Counter()
    if held:
        yield rows(held)


def word_counts(docs: DataFrame, id_col="doc_id", text_col="text", least=LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur at least ``least`` times."""
    prepare(docs.sparkSession)
    d = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    return d.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# ---- signatures ----

_PART: dict = {}


def _part(letter: str, k: int) -> int:
    """The part of the dimension (letter, k-th occurrence)."""
    p = _PART.get((letter, k))
    if p is None:
        r = _LETTERS.find(letter)
        r = ((r if r >= 0 else ord(letter)) + 7 * k) % (2 * PARTS)
        p = _PART[letter, k] = r if r < PARTS else 2 * PARTS - 1 - r
        if len(_PART) > 100_000:
            _PART.clear()
    return p


def _hash(*x) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, x))) - (1 << 63)


def signatures(word: str):
    """(hashes of the parts, replacement keys, keys as the shorter, keys as the longer word)."""
    content = [""] * PARTS
    before, k = "", 0
    for c in sorted(word):
        k = k + 1 if c == before else 0
        before = c
        content[_part(c, k)] += f"{c}{k} "
    parts = [xxhash.xxh32_intdigest(x) - (1 << 31) for x in content]
    folds = [_hash(parts[0], parts[3]), _hash(parts[1], parts[2])]
    n = len(word)
    half = n // 2
    sides = (word[:half], word[half:])
    replaced = [_hash("r", n, s, sides[s], i, j, parts[i], parts[j]) for s in (0, 1) for i, j in COMBOS]
    short = [_hash("i", n, s, sides[s], f, folds[f]) for s in (0, 1) for f in (0, 1)]
    cut = (n - 1) // 2
    sides = (word[:cut], word[cut + 1:])
    long = [_hash("i", n - 1, s, sides[s], f, folds[f]) for s in (0, 1) for f in (0, 1)]
    return parts, replaced, short, long


def _signed(batches):
    for b in batches:
        x = [signatures(w) for w in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([y[0] for y in x], pa.list_(pa.int32())),
             *[pa.array([y[k] for y in x], pa.list_(pa.int64())) for k in (1, 2, 3)]],
            ["word", "n", "parts", "replaced", "short", "long"])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb) of the near pairs of ``words`` (word, n), each once, in either order."""
    prepare(words.sparkSession)
    s = materialise(words.select("word", "n").mapInArrow(
        _signed, "word string, n long, parts array<int>, replaced array<long>, short array<long>, long array<long>"),
        "spelling-signatures")

    def side(keys, name):
        return s.select("word", "n", "parts", F.posexplode(keys).alias("k", "key")).alias(name)

    a, b = side("replaced", "a"), side("replaced", "b")
    k = F.col("a.k") % len(COMBOS)
    first = F.lit(False)
    for c, (i, j) in enumerate(COMBOS):
        ok = F.lit(True)
        for p in range(j):
            if p != i:
                ok = ok & (F.col("a.parts")[p] != F.col("b.parts")[p])
        first = first | ((k == c) & ok)
    one = F.levenshtein("a.word", "b.word", 1) == 1
    pair = [F.col("a.word").alias("a"), F.col("a.n").alias("na"), F.col("b.word").alias("b"), F.col("b.n").alias("nb")]
    replaced = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.k") == F.col("b.k"))
                      & (F.col("a.word") < F.col("b.word")) & first & one).select(pair)
    a, b = side("short", "a").drop("parts").alias("a"), side("long", "b").drop("parts").alias("b")
    cut = F.expr("char_length(a.word) div 2").cast("int")
    apart = F.substring(F.col("a.word"), F.lit(1), cut) != F.substring(F.col("b.word"), F.lit(1), cut)
    inserted = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.k") == F.col("b.k"))
                      & ((F.col("a.k") < 2) | apart) & one).select(pair)
    out = materialise(replaced.union(inserted), "spelling-pairs")
    discard(s)
    return out


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n)."""
    words = materialise(words, "spelling-words")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("w"), F.struct((-F.col("nb")).alias("n"), F.col("b").alias("word")).alias("near")),
        F.struct(F.col("b").alias("w"), F.struct((-F.col("na")).alias("n"), F.col("a").alias("word")).alias("near")))).alias("x"))
    best = both.select("x.w", "x.near").groupBy("w").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    has = -F.col("near.n") >= 2 * F.col("n")
    rows = materialise(words.join(best, F.col("word") == F.col("w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("near.word")).alias("form"), F.when(has, -F.col("near.n")).alias("form_n")), "spelling-rows")
    discard(pairs)
    discard(words)
    up = materialise(rows.filter("form is not null").select("word", F.col("form").alias("up")), "spelling-up")
    while True:
        a, b = up.alias("a"), up.alias("b")
        nxt = materialise(a.join(b, F.col("a.up") == F.col("b.word"), "left").select(
            "a.word", F.coalesce("b.up", "a.up").alias("up"), F.col("b.up").isNotNull().alias("moved")), "spelling-up")
        more = nxt.filter("moved").limit(1).count()
        discard(up)
        path, up = nxt, nxt.drop("moved")
        up._shared_path = path._shared_path
        if not more:
            break
    r, u = rows.alias("r"), up.alias("u")
    return r.join(u, F.col("r.word") == F.col("u.word"), "left").select(
        "r.word", "r.form", F.coalesce("u.up", "r.word").alias("root"), "r.n", "r.n_near", "r.form_n")


def op11_spelling(spark, sf_dir):
    return variants(word_counts(table(spark, sf_dir, "documents")))
