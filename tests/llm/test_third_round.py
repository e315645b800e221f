"""Spelling variants, hard negatives and substring dedup against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import hard_negatives, spelling, substring_dedup


# ---- spelling variants ----

def brute_variants(n):
    near = defaultdict(set)
    pattern = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            pattern[w[:i] + "*" + w[i + 1:]].add(w)
            x = w[:i] + w[i + 1:]
            if x in n:
                near[w].add(x)
                near[x].add(w)
    for g in pattern.values():
        for w in g:
            near[w] |= g - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_variants_equal_brute_force(spark):
    r = random.Random(3)
    n = {}
    for base in ["spelling", "aaaaa", "aaaaaaaa", "größer", "abcabc", *("".join(r.choice("abcde") for _ in range(r.randint(5, 9))) for _ in range(60))]:
        for _ in range(25):
            w = list(base)
            for _ in range(r.randint(0, 2)):
                k = r.randrange(len(w))
                w[k:k + 1] = r.choice([[], [w[k], r.choice("abcdeé")], [r.choice("abcdeé")]])
            if len(w) >= 5:
                n["".join(w)] = 3 + int(r.paretovariate(0.6)) % 10 ** 9
    for k in range(12):                   # a long chain of forms
        n["q" * (5 + k)] = 3 * 2 ** k
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)
    got = spelling.variants(words)
    key = lambda x: x[0]
    assert sorted((tuple(x) for x in got.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=key) == sorted(brute_variants(n), key=key)


def test_signatures_meet_exactly_once():
    r = random.Random(5)
    for _ in range(3000):
        a = "".join(r.choice("abcé") for _ in range(r.randint(5, 9)))
        k, how = r.randrange(len(a)), r.randrange(2)
        b = a[:k] + r.choice("abcdé") + a[k + how:]
        if a == b:
            continue
        if how:
            x, y = spelling.signatures(a), spelling.signatures(b)
            same = [k for k in range(12) if x[1][k] == y[1][k]]
            agree = [p for p in range(4) if x[0][p] == y[0][p]]
            assert same and spelling.COMBOS[same[0] % 6] == tuple(agree[:2])
        else:
            s, t = spelling.signatures(a), spelling.signatures(b)
            assert any(p == q for p, q in zip(s[2], t[3]))


def brute_words(docs):
    out = Counter()
    for i, t in docs:
        for m in __import__("re").finditer("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in m.group())
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            out[w] += 1
    return sorted((w, n) for w, n in out.items() if len(w) >= 5 and n >= 3)


def test_word_counts_rule_and_odd_rows(spark, monkeypatch):
    r = random.Random(1)
    vocab = ["Hello", "hello", "ÀÉÎ×aa", "straße", "abc", "ÇA", "longerword", "x" * 40] + ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    docs = [(i, " ".join(r.choice(vocab) + r.choice(["", ",", "1", "Ā"]) for _ in range(r.randint(0, 80)))) for i in range(150)]
    docs += [(None, "Hello hello hello"), (7, None), (7, ""), (8, docs[8][1]), (9, "one" * 50)]
    monkeypatch.setattr(spelling, "HELD", 50)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "'x' as t").repartition(3)
    assert rows(spelling.word_counts(d), "word", "n") == brute_words(docs)
    assert spelling.variants(spelling.word_counts(d.limit(0))).count() == 0


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "Alpha beta " * 500 + "z" * 300 + " gamma"
    whole = spelling.words_of("1", text.encode())
    monkeypatch.setattr(spelling, "PIECE", 37)
    assert spelling.words_of("1", text.encode()) == whole and "".join(spelling._pieces(text)) == text


# ---- hard negatives ----

def brute_negatives(rows_):
    e = sorted({(i, l, tuple(int(np.floor(256 * float(x))) for x in v)) for i, l, v in rows_
                if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for i, l, a in e:
        if i % 100:
            continue
        s = sorted((-sum(x * y for x, y in zip(a, q)), j, m) for j, m, q in e if j != i and len(q) == len(a))
        for p, j, _ in [x for x in s if x[2] == l][:5]:
            ok = [x for x in s if x[2] != l and -30 * p <= -100 * x[0] <= -90 * p][:10]
            out += [(i, j, k, x[1], -p, -x[0]) for k, x in enumerate(ok, 1)]
    return sorted(out)


NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("dim,block,anchor_block", [(4, 40, 2), (16, 4096, 1024)])
def test_hard_negatives_equal_brute_force(spark, dim, block, anchor_block):
    r = np.random.default_rng(dim)
    data = [(int(i), int(r.integers(3)), [float(x) for x in np.round(r.normal(size=dim) + 0.4, 1)]) for i in range(-100, 400)]
    data += [(1000 + k, k % 3, [0.5] * dim) for k in range(120)]          # many ties
    data += [(2000, 1, [0.0] * dim), (2100, 1, [-0.5] * dim), (None, 1, [0.1] * dim), (2200, None, [0.1] * dim), (2300, 1, None),
             (2400, 1, []), (2500, 1, [float("nan")] * dim), (2600, 1, [None] * dim), (2700, 1, [float("inf")] * dim), (2800, 2, [0.3] * (dim + 1)),
             (2900, 2, [0.2] * (dim + 1)), data[100], data[100]]
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 as id", "2 as q", "3 as dim", "4 as rb").repartition(3)
    data = [(i, l, v and [None if x is None else float(np.float32(x)) for x in v]) for i, l, v in data]
    got = rows(hard_negatives.mine(df, F.col("id") % 100 == 0, block=block, anchor_block=anchor_block), *NAMES)
    assert got == brute_negatives(data) and len(got) > 100


def test_threshold_stops_before_the_lists_end():
    r = np.random.default_rng(1)
    q = r.integers(-50, 50, (4000, 3))
    q[:30] = 1000                                    # far ahead of the rest
    b = hard_negatives.Block(np.arange(4000), np.zeros(4000, np.int64), q)
    read = []
    b.q = type("Counted", (), {"__getitem__": lambda self, k: (read.append(len(k)), q[k])[1]})()
    (found, scores), = b.search(np.array([3, 2, 1]), np.ones(4000, bool), [(-10 ** 9, 10 ** 9, 5)])
    assert found.tolist() == [0, 1, 2, 3, 4] and sum(read) < 400


def test_hard_negatives_without_rows_and_too_large(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(df, F.col("id") % 100 == 0).count() == 0
    big = spark.createDataFrame([(0, 1, [1e9, 1e9])], df.schema)
    with pytest.raises(ValueError):
        hard_negatives.mine(big, F.col("id") % 100 == 0)


# ---- substring dedup ----

def brute_substrings(docs, length):
    first, out = {}, []
    lo = -(1 << 63)
    words = [(lo if i is None else i, (t or "").encode().split()) for i, t in docs]
    for i, w in words:
        for k in range(len(w) - length + 1):
            key = tuple(w[k:k + length])
            first[key] = min(first.get(key, i), i)
    for (i, w), (raw, _) in zip(words, docs):
        gone = bytearray(len(w))
        for k in range(len(w) - length + 1):
            if first[tuple(w[k:k + length])] < i:
                gone[k:k + length] = b"\1" * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((raw is not None, raw or 0, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), spans))
    return sorted(out)


@pytest.mark.parametrize("length,seed", [(50, 20), (8, 3), (5, 5), (3, 1)])
def test_substring_dedup_equals_brute_force(spark, length, seed, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 3000)
    r = random.Random(length)
    word = lambda: r.choice("abcdefgh") * r.randint(1, 2) if length < 50 else f"w{r.randrange(500)}é"
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(length + k) for k in (0, 1, 7, 40)]
    docs = []
    for i in range(60):
        parts = [text(r.randint(0, 2 * length))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(shared), text(r.randint(0, 20))]
        docs.append((i * 3 - 20, r.choice([" ", "\n", "\t  "]).join(parts)))
    docs += [(500 + i, docs[4][1]) for i in range(40)]                               # copies
    docs += [(None, docs[5][1]), (None, None), (900, None), (901, ""), (902, "  \n"), (903, shared[3] + " " + text(4000)),
             docs[7], (docs[8][0], docs[9][1]), (904, "\x00" + shared[2]), (905, text(length - 1))]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as th", "3 as substring_dedup", "4 as starts").repartition(4)
    out = substring_dedup.dedup_substrings(d, length=length, seed=seed)
    assert out.columns == [*d.columns, "substring_dedup_"]
    x = F.col("substring_dedup_")
    got = sorted((a is not None, a or 0, *rest) for a, *rest in out.select(
        "doc_id", x["n_words"], x["n_removed"], F.sha2(F.coalesce(x["text"], F.lit("")), 256), F.size(x["spans"])).collect())
    assert got == brute_substrings(docs, length)


def test_rolling_hash_depends_on_the_words_only():
    w = np.random.default_rng(0).integers(0, 1 << 63, 300).astype(np.uint64)
    again = np.concatenate([w[:7], w, w[3:90]])
    a, b = substring_dedup.rolling(w, 50), substring_dedup.rolling(again, 50)
    assert (b[7:7 + len(a)] == a).all() and (b[307:307 + 38] == a[3:41]).all() and len(set(a.tolist())) == len(a)
    assert substring_dedup.rolling(w[:49], 50).size == 0


def test_substring_dedup_of_an_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.dedup_substrings(d).count() == 0
