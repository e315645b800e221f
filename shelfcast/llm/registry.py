"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from shelfcast.llm import bpe, decontaminate, hard_negatives, jaccard, line_dedup, minhash, quality, secret_scan, shard, spelling, substring_dedup, suffix_dedup, warc
from shelfcast.llm import oracle


def queries():
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_jaccard_join": jaccard.op3_jaccard_join,
        "op4_warc": warc.op4_warc,
        "op5_quality": quality.op5_quality,
        "op6_secret_scan": secret_scan.op6_secret_scan,
        "op7_histogram_sort": shard.op7_histogram_sort,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_minhash": minhash.op9_minhash,
        "op10_byte_bpe": bpe.op10_byte_bpe,
        "op11_spelling": spelling.op11_spelling,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_substring_dedup": substring_dedup.op13_substring_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return dict(oracle.SQL) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
