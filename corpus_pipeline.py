"""A training-corpus pipeline over ``documents`` (each stage is written and read again).

quality rules -> line dedup -> near-duplicate removal -> source mixing -> byte-level BPE.
The first four return the columns of ``documents``; the last returns the tokens' digests of
every document that the mix took.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.llm import bpe, line_dedup, mixing, ngram_join, quality
from mirador.llm.common import prepare, read_table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.quality_filter(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = line_dedup.remove_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long"))      # the text has changed


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ngram_join.one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mix(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe.round_trip(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("ngram_jaccard", near_duplicates),
          ("mixing", mix_sources), ("byte_bpe", encode_bpe)]

# Compression ratios, seeded repetitions and BPE have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read back."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
