"""The pipeline's stages on planted cases, each judged on its own input."""

import random

import corpus_pipeline as P
from conftest import SF_SMALL

from shelfcast.llm import decontaminate


def planted(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, "\n".join(prose(40) for _ in range(5)), "en", "s", 0) for i in range(40)]
    shared = "\n".join(prose(25) for _ in range(4))
    docs += [(100 + i, prose(50) + "\n" + shared, "en", "s", 0) for i in range(3)]
    docs += [(200, docs[0][1], "en", "s", 0), (201, docs[1][1] + " end", "en", "s", 0), (202, None, "en", "s", 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), shared


def test_line_stage_keeps_first_passage(spark):
    docs, shared = planted(spark)
    got = {r.doc_id: r for r in P.dedup_lines(spark, docs, SF_SMALL).collect()}
    assert shared in got[100].text and shared not in got[101].text and shared not in got[102].text
    assert got[101].n_chars == len(got[101].text) and got[202].text is None
    assert got[200].text == "" and got[0].text == dict((r.doc_id, r.text) for r in docs.collect())[0]


def test_join_stage_keeps_one_of_each_group(spark):
    docs, _ = planted(spark)
    got = P.jaccard_join(spark, docs, SF_SMALL)
    assert got.columns == docs.columns
    kept = {r.doc_id for r in got.collect()}
    assert kept == set(range(40)) | {100, 101, 102, 202}


def test_decontamination_stage_drops_and_keeps(spark):
    docs, _ = planted(spark)
    item = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").first().text
    more = spark.createDataFrame([(500, "x " + item + " y", "en", "s", 0), (501, "clean " * 9, "en", "s", 0)], docs.schema)
    kept = {r.doc_id for r in P.benchmark_decontamination(spark, docs.union(more), SF_SMALL).collect()}
    assert kept == {r.doc_id for r in docs.collect()} | {501}


def test_pipeline_runs_all_stages(spark):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination",
                                        "byte-level BPE encoding and decoding"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    out = P.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    kept = {r.doc_id for r in out.collect()}
    good = {r.doc_id for r in labels.filter("quality = 1 and toxic = 0").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    auto = [decontaminate.SuffixAutomaton([(str(i), decontaminate.words_of(t)) for i, t in bench])]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert kept <= set(texts)
    # labelled clean documents that are neither copies nor contaminated stay, but for a few misjudged ones
    clean = [i for i in good if (lambda w: not (w[1] and 20 * w[1] >= w[0]))(decontaminate.judge(texts[i], auto))]
    assert len(kept & set(clean)) >= 0.85 * len(clean)
