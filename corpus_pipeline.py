"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, mixture.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of
``documents`` (the last one the mixture's rows). ``run`` writes and rereads between stages, as the check does.

1. quality: documents that the classifier scores below 0.3 go.
2. near_duplicates: of each component of the n-gram Jaccard join one row with the smallest doc_id stays.
3. repeated_passages: bytes covered by a 150-byte string that starts elsewhere too are cut out where a run of them holds
   51 whole words or 400 bytes; documents of which nothing but white space is left by that go. 51 words of ordinary text
   are longer than 150 bytes (all but about 0.1 % at sf0.1); repeats of shorter ones stay.
4. benchmark_leaks: documents that hold a benchmark window go.
5. mixture: leaves of the domain-language-source tree get their token budgets; a row per document and epoch taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.llm import decontam, jaccard, mixing, quality, suffixes
from ashlar.llm.store import drop, staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labels whose fold isn't held out, keep what is predicted 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~quality.held_out(F.col("doc_id")))
    return quality.classify(docs, quality.fit(docs, labels)).filter("predicted = 1").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the one with the smallest doc_id, null last. Rows count by themselves, not by doc_id."""
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")  # written once, so that numbers stay
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    joined = jaccard.join(rows.select(key.alias("_key"), "text"), key="_key")
    keep = staged(joined.filter("_key = component_id").select("_key._row"), "kept-rows")
    for old in joined._ashlar_reads:  # else they lie on disk beside what the next stages write
        drop(old)
    return rows.join(keep, "_row").select(*docs.columns)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffixes.dedup(docs.withColumn("_size", F.octet_length("text")), length=150, words=51)
    whole = F.octet_length("text") >= F.col("_size")
    return out.filter(F.col("text").isNull() | whole | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.op2(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("benchmark_leaks", benchmark_stage),
    ("mixture", mixture_stage),
]

#: trees, components and suffix ties are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
