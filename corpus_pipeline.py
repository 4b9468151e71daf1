"""The corpus pipeline: five of the training-data operators, one after the other over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.llm import linededup, mixing, packing, quality, simhash
from framelark.llm.common import saved


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), accept=0.7)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows. A document that loses all its lines is empty, and stays."""
    kept = linededup.dedup_lines(docs, least=10)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the row of the smallest id.

    Links are pairs of a Jaccard similarity of 0.8 or more of their sets of 5-word shingles, each compared exactly. Candidates are
    SimHash groups (19 of 128 bits, which such sets differ in on average; 10 of the first 64 are searched) and MinHash bands,
    which catch those pairs whose fingerprints differ more.
    """
    return simhash.deduplicated(docs, bits=10, words=5, wide=19, alike=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mixed_documents(docs, (5, 2, 1), 3)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document and the sequence it stands in."""
    return packing.packed(docs, packing.LENGTHS)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: No SQL: classifier and fingerprints are beyond it. tests/llm holds each stage, and run() against the stages, to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
