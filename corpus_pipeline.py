"""Documents to token ids: the stages of a training corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import bpe, mixing, near_dup, quality, toxicity
from lorekeep.llm.common import saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.good_documents(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity grammar rejects."""
    return toxicity.clean_documents(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dup.first_of_each_class(docs.select(COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs.select(COLUMNS))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encoded_documents(docs.select(COLUMNS))


#: Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
#: written as Parquet and read again as the next one's docs.
STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dup", near_dup_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

#: Models and signatures have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
