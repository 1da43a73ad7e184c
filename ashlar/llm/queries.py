"""Queries opN_<name> and pipeline over the driver's tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from ashlar.llm import chat, decontam, jaccard, langid, lm, mixing, quality, spots, suffixes, warc

_SQL: dict[str, str] = {"op2_mixing": mixing.SQL, "op4_decontamination": decontam.SQL, "op5_warc": warc.SQL, "op10_chat_format": chat.SQL}


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def op1_language_id(spark, d):
    return langid.op1(_docs(spark, d))


def op2_mixing(spark, d):
    return mixing.op2(_docs(spark, d))


def op3_lm_scoring(spark, d):
    return lm.op3(_docs(spark, d))


def op4_decontamination(spark, d):
    return decontam.op4(_docs(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


def op5_warc(spark, d):
    return warc.op5(spark.read.parquet(f"{d}/pages.parquet"))


def op6_suffix_dedup(spark, d):
    return suffixes.op6(_docs(spark, d))


def op7_ngram_jaccard(spark, d):
    return jaccard.op7(_docs(spark, d))


def op8_spot_fingerprints(spark, d):
    return spots.op8(_docs(spark, d))


def op9_quality(spark, d):
    return quality.op9(_docs(spark, d), spark.read.parquet(f"{d}/labels.parquet"))


def op10_chat_format(spark, d):
    return chat.op10(spark.read.parquet(f"{d}/conversations.parquet"))


def pipeline(spark, d):
    return corpus_pipeline.run(spark, d)


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_mixing, op3_lm_scoring, op4_decontamination, op5_warc, op6_suffix_dedup, op7_ngram_jaccard, op8_spot_fingerprints, op9_quality, op10_chat_format, pipeline)}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
