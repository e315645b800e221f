"""Decontamination, line dedup, secret scan and byte-level BPE against brute force."""

import base64
import hashlib
import random
import re

import pytest

from shelfcast.llm import bpe, decontaminate, line_dedup, secret_scan


# ---- benchmark decontamination ----

def words(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute_hits(text, items, window=13):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(len(v), window)
        grams = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i:i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def contaminated():
    r = random.Random(5)
    vocab = ["a", "B", "cé", "d1", "E", "f", "über"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(n))) for i, n in enumerate([40, 30, 13, 14, 5, 2, 0, 25])] + [(99, None)]
    docs = []
    for k in range(80):
        parts = []
        for _ in range(r.randint(0, 4)):
            t = r.choice(items)[1] or ""
            v = t.split()
            a = r.randint(0, max(0, len(v) - 1))
            parts.append(", ".join(v[a:a + r.randint(1, 30)]).upper() if r.random() < .3 else " ".join(v[a:a + 30]))
            parts.append(" ".join(r.choice(vocab + ["zz", "q-q"]) for _ in range(r.randint(0, 60))))
        docs.append((k, "\n".join(parts)))
    return items, docs + [(100, None), (101, ""), (None, docs[3][1]), (3, docs[3][1])]


@pytest.mark.parametrize("block_words", [10 ** 6, 30])
def test_decontaminate_equals_brute_force(spark, contaminated, block_words):
    items, docs = contaminated
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n_words")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.annotate(d, b, block_words=block_words).collect()
    assert len(got) == len(docs)
    want = sorted((brute_hits(t, items) + ((i is None, i or 0),)) for i, t in docs)
    assert sorted((r.n_words, r.n_hit, r.item_ids, (r.doc_id is None, r.doc_id or 0)) for r in got) == want
    for r in got:
        assert all(x.start < x.stop for x in r.spans)
    kept = decontaminate.decontaminate(d, b, block_words=block_words)
    assert kept.columns == d.columns
    clean = [(i, t) for i, t in docs for n, h, _ in [brute_hits(t, items)] if not (h and 20 * h >= n)]
    assert sorted(kept.select("doc_id", "text").collect(), key=str) == sorted(clean, key=str)


def test_decontaminate_cuts_long_spans(spark):
    item = " ".join(f"w{i}" for i in range(20))
    text = "x " * 500 + item + " y"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontaminate.decontaminate(d, b, max_span_words=15).first().text == "x " * 500 + " y"
    assert decontaminate.decontaminate(d, b, max_span_words=20).first().text == text
    assert decontaminate.decontaminate(d, b.limit(0)).first().text == text
    assert decontaminate.annotate(d.limit(0), b).count() == 0


# ---- line dedup ----

def brute_lines(docs, n=3):
    seen, gone = set(), {}
    for i, (key, t) in enumerate(docs):
        lines = t.split("\n") if t is not None else []
        for k in range(len(lines) - n + 1):
            w = tuple(lines[k:k + n])
            if not "".join(w).strip(" \r\t\n"):
                continue
            if w in seen:
                gone.setdefault(i, set()).update(range(k, k + n))
            seen.add(w)
    return {key: (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())))
            for i, (key, t) in enumerate(docs)}


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(1)
    lines = ["a", "b", "c", "", " ", "d\r", "é"]
    docs = [(k, "\n".join(r.choice(lines) for _ in range(r.randint(0, 9)))) for k in range(60)]
    docs += [(60, None), (61, ""), (62, "only\ntwo"), (63, "\n\n\n\n"), (64, "a\na\na\na\na")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 as h", "8 as line").repartition(5)
    got = {x.doc_id: x.line_dedup.text for x in line_dedup.dedup_lines(d).collect()}
    assert got == brute_lines(docs)


def test_line_dedup_repeated_rows_and_empty_table(spark):
    t = "p\nq\nr\ns"
    d = spark.createDataFrame([(1, t), (1, t), (None, t), (2, "x\n" + t)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.line_dedup.text) for r in line_dedup.dedup_lines(d).collect())
    # the null id comes first and keeps its lines; equal rows lose the same lines
    assert got == [("1", ""), ("1", ""), ("2", "x"), ("None", t)]
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


# ---- secret scan ----

def brute_spans(text, rules):
    out = []
    for o, r in enumerate(rules):
        rx = re.compile(r.regex, re.ASCII)
        out += [(m.start(), o, m.end(), r.kind) for m in rx.finditer(text or "") if len(m.group(r.group)) >= r.least]
    return [(s, e, k) for s, _, e, k in sorted(out)]


def test_secret_scan_equals_brute_force(spark):
    r = random.Random(2)
    bits = ["password", "PassWD", "Api_Key", "apikey", "secret", "token", "ſecret", "Key", "=", ":", ' = "', "' :  '", "abc", "abcdef", "é ",
            "AKIA", "AKIA" + "Q7" * 9, "akia", "deadbeef" * 3, "0123456789abcdef" * 2, "DEAD", " ", "\n", "ghp_" + "a1" * 20, "eyJ",
            "eyJab.eyJcd" + "x" * 20 + ".zz", "-----BEGIN RSA PRIVATE KEY-----", "𝒳", "secret=token : abcdefgh"]
    docs = [(k, "".join(r.choice(bits) for _ in range(r.randint(0, 14)))) for k in range(300)] + [(300, None), (301, ""), (None, "token=abcdefg"), (5, "x")]
    rules = secret_scan.BASE + secret_scan.ADDED
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'z' as kinds", "'y' as term")
    got = sorted((str(x.doc_id), [tuple(s) for s in x.spans]) for x in secret_scan.scan(d).collect())
    assert got == sorted((str(i), brute_spans(t, rules)) for i, t in docs)
    assert secret_scan.scan(d.limit(0)).count() == 0


def test_trigram_queries():
    q = {r.kind: secret_scan.trigram_query(r) for r in secret_scan.BASE}
    assert q["access"] == [frozenset({"AKI", "KIA"})]
    assert q["hex"] is None
    assert frozenset({"tok", "oke", "ken"}) in q["assign"]
    assert frozenset({"api", "pik", "ike", "key"}) in q["assign"] and frozenset({"api", "pi_", "i_k", "_ke", "key"}) in q["assign"]


def test_secret_scan_of_a_text_full_of_secrets(spark):
    import time
    text = " ".join(f"token=abc{i:05d} AKIA{i:020d}" for i in range(8000)) + " tail"
    d = spark.createDataFrame([(1, text), (2, "token=abcdef"), (3, "")], "doc_id long, text string")
    t = time.time()
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.scan(d).collect()}
    spent = time.time() - t
    want = sorted([(*m.span(), "assign") for m in re.finditer(r"token=[a-z0-9]+", text)]
                  + [(*m.span(), "access") for m in re.finditer(r"AKIA[0-9]+", text)])
    assert [s for s in got[1] if s[2] in ("assign", "access")] == want and len(want) == 16000
    assert got[2] == [(0, 12, "assign")] and got[3] == []
    assert spent < 60, spent


def test_secret_scan_is_native(spark):
    d = spark.createDataFrame([(1, "token=abcdefg")], "doc_id long, text string")
    plan = secret_scan.scan(d)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- byte-level BPE ----

@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(tiktoken_encoding):
    r = random.Random(0)
    v = bpe.vocabulary(bpe.default_path())
    alphabet = "ab' '  \n\t1²Ⅷé中'''sstmdrevll 　!$¡'\u0085\U0001F600"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    texts += ["a" * 5000, "ab" * 3000 + "é" * 99, " " * 777, "!?" * 2500, "<|endoftext|>", "don't 'tis we'll 's's"]
    for t, (ids, offsets) in zip(texts, bpe.encode_texts(texts, bpe.default_path())):
        assert ids.tolist() == tiktoken_encoding.encode_ordinary(t)
        assert v.decode(ids, offsets) == t.encode()
        if len(ids) > 2:  # a run of tokens, by its offsets
            assert v.decode(ids[1:-1], offsets[1:-1]) == t.encode()[offsets[1]:offsets[-2]]


def test_bpe_classes_equal_library(tiktoken_encoding):
    some = [c for c in range(0, 0x110000, 61) if not 0xD800 <= c < 0xE000] + list(range(0x250)) + list(range(0x2000, 0x2070))
    texts = [f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}a" for c in some]
    got = bpe.encode_texts(texts, bpe.default_path())
    assert [g[0].tolist() for g in got] == tiktoken_encoding.encode_ordinary_batch(texts)


def test_bpe_jobs(spark, tiktoken_encoding):
    docs = [(1, "Hello wörld, it's 42!"), (2, None), (3, ""), (None, "x"), (1, "Hello wörld, it's 42!"), (4, "lang " * 9000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as offsets")
    e = bpe.encode(d)
    got = sorted((str(r.doc_id), bytes(r.bytes).decode()) for r in bpe.decode(e).collect())
    assert got == sorted((str(i), t or "") for i, t in docs)
    for r in bpe.round_trip(d).collect():
        t = dict(docs)[r.doc_id] or ""
        ids = tiktoken_encoding.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.round_trip(d.limit(0)).count() == 0
