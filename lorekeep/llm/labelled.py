"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import BROADCAST_ROWS, small, unit_hash

#: Labelled rows that a classifier is fitted on, about; all others are only scored.
SAMPLE = 20_000


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """(doc_id, text, label) of a seeded sample of the labelled documents that are not held out.

    The sample is drawn from the labels, so only its ids meet the documents; they are
    broadcast, being bounded by ``sample``.  A doc_id labelled more than once has its largest label, and one
    with several rows its smallest text that isn't null, so repeated ids can't exceed the sample.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    n = own.count()
    if n > sample:
        own = own.where(unit_hash(F.col("doc_id"), seed=seed) < sample / n)
    met = docs.select("doc_id", "text").join(small(own, max(2 * sample, BROADCAST_ROWS)), "doc_id")
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
