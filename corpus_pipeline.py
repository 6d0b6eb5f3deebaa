"""The corpus pipeline: stages of the subpackage llm, each written as Parquet and read again by the next.

Each stage works on all documents that the one before kept: quality rules drop rejected documents, near duplicates
keep one document of each class, repeated byte strings are cut out of the texts (n_chars follows), contaminated
documents go, and what is left is encoded and decoded by byte-level BPE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrillo.llm.bpe import byte_bpe
from corrillo.llm.common import table, written
from corrillo.llm.decontaminate import drop_contaminated
from corrillo.llm.minhash import keep_one
from corrillo.llm.quality import keep_good
from corrillo.llm.suffix import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL cannot express compression ratios, consistent weighted sampling or byte-level BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
