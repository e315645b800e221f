"""Jaccard join, MinHash, suffix dedup, WARC, sharding and the classifier against
brute force, exact round trips and held-out accuracy."""

import base64
import collections
import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import common, jaccard, minhash, quality, shard, suffix_dedup, warc

from conftest import SF_MID


# ---- n-gram Jaccard join ----

def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(docs):
    sets = [shingles(t, 3) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 90 * (len(sets[a]) + len(sets[b]) - i):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)] if s else i) for k, ((i, _), s) in enumerate(zip(docs, sets)))


def near_copies(r, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            k = r.randrange(len(w))
            w[k:k + 1] = r.choice([[f"n{r.randrange(10 ** 6)}"], [], [w[k], f"m{r.randrange(10 ** 6)}"]])
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def similar():
    r = random.Random(7)
    word = lambda: f"w{r.randrange(3000)}"
    texts = []
    for size, n, edits in ((150, 130, 8), (60, 60, 3), (300, 30, 20), (12, 40, 1), (18, 30, 2), (20, 30, 2), (5, 8, 1)):
        texts += near_copies(r, [word() for _ in range(size)], n, edits)
    passage = [word() for _ in range(30)]
    texts += [" ".join([word() for _ in range(r.randint(5, 80))] + passage + [word() for _ in range(r.randint(5, 80))]) for _ in range(80)]
    texts += [" ".join(passage)] * 5 + [texts[3]] * 40 + ["", "   ", "One", "one", "one two", "A b\tc", "a B c"]
    r.shuffle(texts)
    return list(enumerate(texts, 10))


@pytest.mark.parametrize("star_cost", [128, 2])
def test_jaccard_join_equals_brute_force(spark, similar, monkeypatch, star_cost):
    monkeypatch.setattr(jaccard, "STAR_COST", star_cost)   # 2: nearly all lists are heavy
    docs = [*similar, (900, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as sid", "2 as token").repartition(4)
    got = sorted(tuple(x) for x in jaccard.join(d).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(docs)


def test_jaccard_join_without_frequent_order(spark, similar, monkeypatch):
    monkeypatch.setattr(jaccard, "frequent_order", lambda f: np.zeros(0, np.uint64))
    docs = similar[::2]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(x) for x in jaccard.join(d).select("doc_id", "n_shingles", "component_id").collect()) == brute_components(docs)


def split_entries():
    """Sets that share 2 entries of light lists and 1 of a heavy list whose pivot is far from them; 3 are asked for.
    x: 100 frequent shingles; y: x and 11 rare ones; fillers make x's first entries frequent, in one list more than 257."""
    r = np.random.default_rng(5)
    x = np.unique(r.integers(1, 2 ** 62, 100).astype(np.uint64))
    own = r.integers(1, 2 ** 62, 11).astype(np.uint64)
    sets = {1: x, 2: np.unique(np.append(x, own))}
    lists = [(100 + k, sid) for k in range(3) for sid in (1, 2)]
    for k in range(300):     # the heavy list 100: others, far from both and from one another
        sets[10 + k] = np.unique(r.integers(1, 2 ** 62, 100).astype(np.uint64))
        lists.append((100, 10 + k))
    return sets, lists


def test_jaccard_lists_split_over_rounds(spark):
    sets, lists = split_entries()
    common.prepare(spark)
    s = spark.createDataFrame([(i, len(h), w, bytearray(h.tobytes())) for (i, h), w in zip(sets.items(), jaccard.sketches(list(sets.values())).to_pylist())],
                              "sid long, n int, sketch array<long>, hashes binary")
    # the pivot of the heavy list is the set with the fewest rare shingles: not 1 or 2
    d = spark.createDataFrame([(t, i, 0 if i > 2 else 9) for t, i in lists], "token long, sid long, rare int")
    order = ("none", spark.sparkContext.broadcast(np.zeros(0, np.uint64)))
    got = jaccard.list_links(jaccard.shared_lists(d), s.select("sid", "n", "sketch"), lambda wanted: s, order, [],
                             lambda n: F.floor(jaccard.shared(n)) + 1)
    assert {tuple(sorted((r.a, r.b))) for r in got.collect()} == {(1, 2)}


@pytest.mark.parametrize("percent, common_passage", [(90, 1), (80, 1), (90, 150)])
def test_jaccard_long_list_of_far_members(spark, percent, common_passage):
    """5,000 sets in the same lists, far from one another but for 20 pairs: no list is compared pair by pair."""
    r = np.random.default_rng(8)
    passage = r.integers(1, 2 ** 62, common_passage).astype(np.uint64)
    sets = {k: np.unique(np.append(r.integers(1, 2 ** 62, 60).astype(np.uint64), passage)) for k in range(5000)}
    for k in range(20):
        sets[5000 + k] = np.unique(np.append(sets[k], r.integers(1, 2 ** 62, 2).astype(np.uint64)))
    common.prepare(spark)
    values = list(sets.values())
    s = spark.createDataFrame([(i, len(h), w, z, bytearray(h.tobytes())) for (i, h), w, z in zip(
        sets.items(), jaccard.sketches(values).to_pylist(), jaccard.wide_sketches(values).to_pylist())],
        "sid long, n int, sketch array<long>, wide binary, hashes binary")
    d = spark.createDataFrame([(int(t), i, 1) for t in passage.astype(np.int64)[:3] for i in sets], "token long, sid long, rare int")
    order = ("none", spark.sparkContext.broadcast(np.zeros(0, np.uint64)))
    got = jaccard.list_links(jaccard.shared_lists(d), s.select("sid", "n", "sketch", "wide"), lambda wanted: s, order, [], percent=percent)
    assert {tuple(sorted((x.a, x.b))) for x in got.collect()} == {(k, 5000 + k) for k in range(20)}


def test_wide_sketches_bound_the_difference():
    r = np.random.default_rng(6)
    for size, drop, add in ((1100, 10, 0), (1500, 40, 60), (2040, 0, 30), (9000, 300, 500)):
        x = np.unique(r.integers(1, 2 ** 62, size).astype(np.uint64))
        y = np.unique(np.append(x[drop:], r.integers(1, 2 ** 62, add).astype(np.uint64)))
        z = np.unique(r.integers(1, 2 ** 62, size).astype(np.uint64))
        a, b, c = jaccard.wide_sketches([x, y, z]).to_pylist()
        assert jaccard.wide_difference(a, b) <= len(np.setxor1d(x, y))
        assert jaccard.wide_difference(a, c) > (len(x) + len(z)) / 9 and jaccard.wide_difference(a, a) == 0
    assert jaccard.wide_sketches([x[:5]]).to_pylist() == [None]


def test_jaccard_pivot_at_the_limit_settles():
    # distance 3/10 from the pivot: what the rounds leave out has to be listed here
    x, p = (np.array(v, np.uint64) for v in (range(9), [*range(2, 9), 10]))
    rows = jaccard.differences(jaccard.Order(np.zeros(0, np.uint64)), x, p, 7, 1, 2)
    assert {r[0] for r in rows} == {1, 2}


def test_jaccard_join_edges(spark):
    d = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "A B C D"), (4, "A B C D"), (None, "x y z"), (None, None)],
                              "doc_id long, text string")
    got = sorted(map(str, (tuple(x) for x in jaccard.join(d).select("doc_id", "n_shingles", "component_id").collect())))
    assert got == sorted(["(None, 2, 4)"] * 2 + ["(4, 2, 4)"] * 2 + ["(None, 1, None)", "(None, 0, None)"])
    assert jaccard.join(d.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 60)]
    got = dict(tuple(r) for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 0 for i in range(1, 60)}}


# ---- MinHash ----

def test_minhash_neighbours_and_edits(spark):
    r = random.Random(4)
    docs = [(i * 3 % 101, " ".join(r.choice("ab cd éf gh ij kl".split()) for _ in range(r.randint(0, 30)))) for i in range(101)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    order = sorted(docs, reverse=True)
    for rows in (20_000, 9):
        got = {x.doc_id: x for x in minhash.with_edits(d, rows_a_range=rows).collect()}
        assert len(got) == len(docs)
        for k, (i, t) in enumerate(order):
            nxt = order[(k + 1) % len(order)][1]
            half = len(t) // 2
            e = t[:len(t) - half] + nxt[:half]
            assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
            assert got[i].n_chars == len(t)
            true = len(shingles(t, 5) & shingles(e, 5)) / max(1, len(shingles(t, 5) | shingles(e, 5)))
            assert abs(got[i].near_edited - true) < 0.25 or not t


def test_minhash_likeness_is_near_jaccard():
    r = random.Random(9)
    errors = []
    for _ in range(60):
        a = [f"w{r.randrange(10 ** 5)}" for _ in range(300)]
        b = list(a)
        for _ in range(r.randint(0, 60)):
            b[r.randrange(300)] = "x"
        sa, sb = (common.shingle_hashes(" ".join(x), 5) for x in (a, b))
        true = len(np.intersect1d(sa, sb)) / len(np.union1d(sa, sb))
        errors.append(minhash.likeness(minhash.signature(sa), minhash.signature(sb)) - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_minhash_pairs_are_verified(spark):
    r = random.Random(3)
    base = [[f"w{r.randrange(10 ** 5)}" for _ in range(200)] for _ in range(20)]
    texts = [t for b in base for t in near_copies(r, b, 6, 4)] + [" ".join(base[0])] * 9 + [None, ""]
    docs = list(enumerate(texts))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    prints = minhash.fingerprints(d)
    got = minhash.near_pairs(d, prints).collect()
    linked = {x.id for x in got} | {x.near_id for x in got}
    for x in got:
        a, b = (shingles(texts[i], 5) for i in (x.id, x.near_id))
        assert abs(len(a & b) / len(a | b) - x.jaccard) < 1e-9 and x.jaccard >= 0.8
    near = {i for i, t in docs for j, u in docs if i != j and t != u and shingles(t, 5)
            and len(shingles(t, 5) & shingles(u, 5)) >= 0.9 * len(shingles(t, 5) | shingles(u, 5))}
    first = {}
    for i, t in docs:
        first.setdefault(t, i)
    assert len({first[texts[i]] for i in near} - linked) <= 0.05 * len(near)


def around_a_template(r):
    """A text that the others resemble by 0.6 to 0.75, and pairs of them at about 0.9; unrelated pairs."""
    word = lambda: f"w{r.randrange(10 ** 6)}"
    base = [word() for _ in range(300)]
    texts = [" ".join(base)]
    for _ in range(40):
        w = [*base[:r.randint(225, 250)], *[word() for _ in range(r.randint(10, 25))]]
        texts += [" ".join(w), " ".join(w[:-3] + [word()]), " ".join(w[:60] + [word()] + w[61:])]
    for _ in range(10):
        w = [word() for _ in range(200)]
        texts += [" ".join(w), " ".join(w[:-4] + [word()])]
    return texts


@pytest.mark.parametrize("star_cost", [128, 2])
def test_minhash_classes_equal_brute_force(spark, monkeypatch, tmp_dir, star_cost):
    monkeypatch.setattr(jaccard, "STAR_COST", star_cost)   # 2: groups around the template go through heads and rounds
    texts = around_a_template(random.Random(12))
    texts += [texts[1], texts[2], texts[0], None, "", "  ", "\n"]
    docs = [(i * 7 % 401, t) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_dir}/documents.parquet")
    got = {x.doc_id: x for x in minhash.op9_minhash(spark, tmp_dir).collect()}
    assert len(got) == len(docs)
    sets = {i: shingles(t, 5) for i, t in docs}
    text = {i: t or "" for i, t in docs}
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    alike = set()
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            link = both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)
            if i < j and (link or text[i] == text[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
            if link and text[i] != text[j]:
                alike.add((i, j))
    assert {i: x.class_id for i, x in got.items()} == {i: find(i) for i in root}
    assert all((x.near_id is not None) == any(a == i for a, _ in alike) for i, x in got.items())
    assert all(x.near_id is None or (i, x.near_id) in alike for i, x in got.items())


def test_minhash_edges(spark):
    d = spark.createDataFrame([(7, None), (7, ""), (None, "a b"), (3, "q" * 50)], "doc_id long, text string")
    got = minhash.with_edits(d).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got if r.n_chars == 0}) == 1
    assert minhash.with_edits(d.limit(0)).count() == 0
    one = minhash.with_edits(d.filter("doc_id = 3")).first()
    assert one.near_next == 1.0


# ---- suffix dedup ----

def brute_strings(texts, limit):
    count = collections.Counter(b[i:i + limit] for t in texts for b in [(t or "").encode()] for i in range(len(b) - limit + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for i in range(len(b) - limit + 1):
            if count[b[i:i + limit]] > 1:
                covered[i:i + limit] = b"\1" * limit
        runs = sum(1 for k in range(len(b)) if covered[k] and (k == 0 or not covered[k - 1]))
        out.append((len(b), sum(covered), runs, hashlib.sha256(bytes(x for x, c in zip(b, covered) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("limit,step,char", [(40, 8, 15), (40, 4, 5), (64, 16, 25)])
def test_suffix_dedup_equals_brute_force(spark, limit, step, char):
    r = random.Random(3)
    pieces = ["".join(r.choice("abcdé ") for _ in range(r.randint(30, 200))) for _ in range(12)]
    texts = []
    for _ in range(60):
        t = ""
        for _ in range(r.randint(0, 6)):
            p = r.choice(pieces)
            t += p[r.randint(0, len(p) // 2):] if r.random() < .6 else "".join(r.choice("abcd") for _ in range(r.randint(1, 60)))
        texts.append(t)
    texts += ["a" * 500, "ab" * 200, "a" * (limit - 1), texts[3], "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as th", "2 as a").repartition(3)
    got = {x.doc_id: x for x in suffix_dedup.dedup_strings(d, limit=limit, step=step, char=char).collect()}
    want = brute_strings(texts, limit)
    assert [(x.n_bytes, x.n_removed, len(x.spans), x.kept_sha256) for _, x in sorted(got.items())] == want
    assert all(hashlib.sha256(x.kept).hexdigest() == x.kept_sha256 for x in got.values())


def test_suffix_dedup_segments_of_long_texts(monkeypatch):
    r = random.Random(1)
    raw = bytes(r.randrange(256) for _ in range(5000))
    whole = suffix_dedup.anchors(suffix_dedup.Hashed(raw))
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 700)
    parts = suffix_dedup.anchors(suffix_dedup.Hashed(raw))
    spread = lambda x: {(a, w) for a, lo, hi in zip(*x) for w in range(lo, hi + 1)}
    assert spread(whole) == spread(parts) and len(spread(whole)) == 5000 - 399


def test_suffix_dedup_edges(spark):
    t = "".join(chr(97 + (i * i) % 23) for i in range(450))
    d = spark.createDataFrame([(1, t), (1, t), (None, "x" + t), (2, "short")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.dedup_strings(d).collect())
    assert got == [("1", 450), ("1", 450), ("2", 0), ("None", 450)]
    assert suffix_dedup.dedup_strings(d.limit(0)).count() == 0


# ---- WARC ----

def digest32(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


@pytest.mark.parametrize("split", ["128m", "3000"])
def test_warc_round_trip(spark, tmp_dir, split):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(i, f"http://x/{i}", f"<p>é{i}</p>" * (i * 7 % 90)) for i in range(120)]
    pages += [(200, "u\r\nX: y", "before " + fake + " after"), (201, None, fake * 3), (202, "u", None), (203, "u", ""),
              (204, "u", "HTTP/1.1 not a head"), (205, "u", "tail\r\n\r\nWARC/1.0\r\n"), (206, "u", "same"), (300, "v", "same"), (250, "w", "same")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        path = os.path.join(tmp_dir, "archive")
        d = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as id", "'s' as same", "2 as winner")
        warc.write_archives(d.repartition(2), path)
        got = {r.record_id: r for r in warc.read_archives(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(pages)
    winner = {}
    for i, _, t in pages:
        winner[t or ""] = max(winner.get(t or "", i), i)
    for i, _, t in pages:
        r, b = got[f"<urn:page:{i}>"], (t or "").encode()
        assert r.stated_digest == "sha1:" + digest32(b)
        if winner[t or ""] == i:
            assert (r.warc_type, r.payload, r.payload_bytes, r.payload_digest) == ("response", t or "", len(b), digest32(b))
        else:
            assert (r.warc_type, r.refers) == ("revisit", f"<urn:page:{winner[t or '']}>")


def test_warc_small_payloads_nulls_and_empty(spark, tmp_dir):
    d = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (None, "u", "long enough"), (3, "u", "long enough")], "page_id long, url string, html string")
    warc.write_archives(d, tmp_dir + "/a", least_bytes=5)
    got = sorted((r.warc_type, r.payload) for r in warc.read_archives(spark, tmp_dir + "/a").collect())
    assert got == [("response", "ab"), ("response", "ab"), ("response", "long enough"), ("revisit", "")]
    warc.write_archives(d.limit(0), tmp_dir + "/b")
    assert warc.read_archives(spark, tmp_dir + "/b").count() == 0


def test_warc_chain_rejects_what_the_start_does_not_reach(spark):
    c = [("f", 0, 0, 50), ("f", 0, 20, 60), ("f", 0, 50, 110), ("f", 100, 110, 150), ("f", 100, 120, 150), ("f", 100, 150, 230),
         ("f", 200, 230, 300), ("f", 200, 240, None), ("g", 0, 0, 33), ("g", 0, 34, 60)]
    d = spark.createDataFrame(c, "file string, split long, at long, next long")
    assert sorted((r.file, r["at"]) for r in warc.chain(d).collect()) == [("f", 0), ("f", 50), ("f", 110), ("f", 150), ("f", 230), ("g", 0)]


# ---- sharding ----

def test_shards_are_balanced_and_gapless(spark):
    r = random.Random(8)
    texts = ["hot" * 100] * 1500 + ["".join(r.choice("abc") for _ in range(r.randint(0, 400))) for _ in range(3000)] + [None, "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as h", "2 as at", "3 as size").repartition(7)
    got = shard.place(d, range_rows=150).collect()
    assert len(got) == len(texts)
    size, slots, groups = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for x in got:
        assert x.placement.size == len((x.text or "").encode()) + 1
        size[x.placement.shard] += x.placement.size
        slots[x.placement.shard].append(x.placement.slot)
        groups[x.text].add(x.placement.shard)
    assert sorted(size) == list(range(8))
    mean = sum(size.values()) / 8
    assert max(abs(v - mean) for v in size.values()) <= 0.0005 * mean + 401
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sum(len(g) > 1 for g in groups.values()) <= 7      # a group is cut only where a boundary runs through it


def test_shards_of_equal_rows_and_empty_table(spark):
    d = spark.createDataFrame([(None, "x")] * 50 + [(1, "y")], "doc_id long, text string")
    got = shard.place(d).collect()
    assert len(got) == 51 and len({(r.placement.shard, r.placement.slot) for r in got}) == 51
    assert shard.place(d.limit(0)).count() == 0


def test_op7_columns(spark):
    from __spark_entry__ import queries
    got = queries()["op7_histogram_sort"](spark, SF_MID).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None for r in got)


# ---- quality classifier ----

def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = quality.fit(docs, labels.filter(~held))
    got = quality.score(docs, model).select("doc_id", "quality_class.*").join(labels.filter(held), "doc_id").collect()
    low = [(r.p_low >= 0.5) == (r.quality == 0) for r in got]
    toxic = [(r.p_toxic >= 0.5) == (r.toxic == 1) for r in got]
    assert np.mean(low) >= 0.97 and np.mean(toxic) >= 0.97, (np.mean(low), np.mean(toxic))
    clean = [r.rejected for r in got if r.quality == 1 and r.toxic == 0]
    assert np.mean(clean) <= 0.03


def test_classifier_views_exchange_labels():
    r = np.random.default_rng(0)
    y = r.integers(0, 2, 600)
    rows = lambda noise: [[int(k) if r.random() > noise else 1 - int(k)] for k in y]
    views = [quality.Sparse(rows(0.0), 2), quality.Sparse(rows(0.0), 2)]
    labelled = np.arange(600) < 60
    held = labelled & (np.arange(600) % 5 == 0)
    m = quality.co_train(views, labelled, np.where(labelled, y, 0), held, ~labelled)
    odds = sum(c * (k[0] * x.dot(w) + k[1]) for c, k, x, w in zip(m["mix"], m["calibration"], views, m["models"]))
    assert np.mean((odds + m["mix"][2] > 0) == (y == 1)) > 0.99
    up, down = quality.confident(np.array([3.0, -3, 0]), np.linspace(-2, 2, 40), (np.linspace(-2, 2, 40) > 0).astype(int))
    assert up.tolist() == [True, False, False] and down.tolist() == [False, True, False]


def test_classifier_pool_is_every_unlabelled_document(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    seen = []

    def sums(pool, width, state):
        seen.append(pool.count())
        return np.zeros(len(state) * (sum(width) + 4))

    monkeypatch.setattr(quality, "over_pool", sums)
    quality.fit(docs, labels, rounds=1)
    few = labels.filter("quality is not null or toxic is not null").select("doc_id")
    assert set(seen) == {docs.join(few, "doc_id", "left_anti").count()}
    late = quality.Classifier([], [np.zeros(11)] * 9, {})
    sources = [late.page_row([0.0] * 9, f"source-{i:05d}", None)[9] for i in range(600, 620)]
    assert len(set(sources)) >= 18       # before, all beyond the first 512 were one column


def test_classifier_over_a_table_equals_the_driver(spark):
    r = np.random.default_rng(1)
    common.prepare(spark)
    y = r.integers(0, 2, 900)
    rows = [[[int(k) if r.random() > noise else 1 - int(k), 2 + int(r.integers(0, 5))] for k in y] for noise in (0.05, 0.1)]
    labelled = np.arange(900) < 200
    held = labelled & (np.arange(900) % 5 == 0)
    views = [quality.Sparse(v, 7) for v in rows]
    want = quality.co_train(views, labelled, np.where(labelled, y, 0), held, ~labelled)
    own = [quality.Sparse(v[:200], 7) for v in rows]
    pool = spark.createDataFrame(list(zip(rows[0][200:], rows[1][200:])), "found array<int>, page array<int>").repartition(3)
    got = quality.co_train_over(own, {"low": y[:200]}, {"low": labelled[:200]}, {"low": held[:200]},
                                lambda state: quality.over_pool(pool, (7, 7), state))["low"]
    for a, b in zip([*got["models"], got["mix"]], [*want["models"], want["mix"]]):
        assert np.allclose(a, b, atol=1e-6)


def test_classifier_edges(spark):
    rows = [(1, "good words here", "en", "s", 15), (2, None, None, None, None), (None, "", "en", "t", 0), (1, "x" * 30000, "de", "s", 30000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("p_low", F.lit(1))
    none = spark.createDataFrame([(1, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(d, none)
    assert got.columns == [*d.columns, "quality_class"]
    assert all(r.quality_class.p_low is None and not r.quality_class.rejected for r in got.collect())
    assert quality.classify(d.limit(0), none).count() == 0


def test_classifier_scores_from_the_fitted_features(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", None, "s", 0)], docs.schema)
    docs = docs.unionByName(odd)
    key = lambda r: (r.doc_id is None, r.doc_id)
    want = sorted(quality.classify(docs, labels).select("doc_id", "quality_class").collect(), key=key)
    got = sorted(quality.judge(docs, labels).collect(), key=key)
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    for a, b in zip(got, want):
        assert np.allclose(a.quality_class[:2], b.quality_class[:2], atol=1e-9) and a.quality_class.rejected == b.quality_class.rejected
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_classifier_sums_by_marks_equal_brute_force(spark):
    """The gradient sums of a judged table, against one document after another."""
    r = np.random.default_rng(2)
    common.prepare(spark)
    rows = [[sorted(r.choice(6, int(r.integers(0, 5)), replace=False).tolist()) for _ in range(500)] for _ in range(2)]
    models = {n: [r.normal(size=7), r.normal(size=7)] for n in ("low", "toxic")}
    cuts = {n: [(-0.6, 0.9), (-1.1, 0.4)] for n in models}
    now = {n: [r.normal(size=7), r.normal(size=7)] for n in models}
    pool = spark.createDataFrame([(quality.packed(a), quality.packed(b)) for a, b in zip(*rows)], "found binary, page binary").repartition(3)
    table = common.materialise(quality.judged(pool, (6, 6), models, cuts), "test-judged")
    assert table.count() == 500
    state = {n: (models[n], cuts[n], now[n]) for n in models}
    got = quality.over_pool(table, (6, 6), state)
    assert np.allclose(got[:len(got)], quality.over_pool(pool, (6, 6), state))
    want = []
    for n in ("low", "toxic"):
        for k in (0, 1):
            g, weight = np.zeros(7), 0.0
            for mine, other in zip(rows[k], rows[1 - k]):
                s = sum(models[n][1 - k][c] for c in [*other, 6])
                low, high = cuts[n][k]
                if s > high or s < low:
                    p = 1 / (1 + np.exp(-sum(now[n][k][c] for c in [*mine, 6])))
                    for c in [*mine, 6]:
                        g[c] += 0.5 * (p - (s > high))
                    weight += 0.5
            want += [*g, weight]
    assert np.allclose(got[:len(want)], want) and not got[len(want):].any()


def test_jaccard_order_counts_over_all_batches(spark):
    """A shingle in few sets of every batch, but in many of all, comes after those that are rare overall."""
    r = np.random.default_rng(3)
    common.prepare(spark)
    word = lambda: "".join(r.choice(list("abcdefghij"), 12))
    passage = "alpha beta gamma"
    texts = [f"{passage} " + " ".join(word() for _ in range(8)) if k % 50 == 0 else " ".join(word() for _ in range(8)) for k in range(5000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)    # 2 or 3 of 125 in a batch
    order = jaccard.Order(jaccard.frequent_order(jaccard.describe(docs)[1]))
    h = common.shingle_hashes(texts[0], 3)
    few, often = order.split(h)
    assert often.tolist() == common.shingle_hashes(passage, 3).tolist()
    assert sorted(few.tolist() + often.tolist()) == h.tolist()
    again = jaccard.counted_shingles(spark.createDataFrame([(bytearray(common.shingle_hashes(t, 3).tobytes()),) for t in texts], "hashes binary"))
    assert (jaccard.frequent_order(again) == order.ranks).all()


def test_minhash_unlike_texts_of_a_band_make_no_pairs(spark, monkeypatch):
    """Texts with a long passage in common share bands, but are less than 80 % alike: the sketches in the lists rule the pairs out."""
    r = np.random.default_rng(4)
    word = lambda k: [f"w{x}" for x in r.integers(0, 10 ** 6, k)]
    passage = word(200)
    texts = [" ".join(passage + word(130)) for _ in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (90, texts[0] + " more")], "doc_id long, text string")
    may_link, asked = jaccard._may_link, []
    monkeypatch.setattr(jaccard, "_may_link", lambda pairs, *a: asked.append(pairs.count()) or may_link(pairs, *a))
    prints = common.materialise(minhash.fingerprints(docs), "prints")
    lists = minhash.bands(prints).groupBy("key").count().filter("count > 2").count()
    near = minhash.near_pairs(docs, prints)
    assert [(x.id, x.near_id) for x in near.collect()] in ([(0, 90)], [(90, 0)])
    assert lists > 0 and max(asked) == 1


def test_sliced_batches_are_bounded_and_whole():
    big = pa.RecordBatch.from_arrays([pa.array(range(2 * common.ROWS_AT_ONCE + 5))], names=["x"])
    got = list(common.sliced(iter([big, big.slice(0, 0), big.slice(0, 7)])))
    assert [b.num_rows for b in got] == [common.ROWS_AT_ONCE] * 2 + [5, 7]
    assert [x for b in got for x in b.column(0).to_pylist()] == [*range(2 * common.ROWS_AT_ONCE + 5), *range(7)]
