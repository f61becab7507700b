"""Retrieval quality of rankings against labelled questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scored(ranking: DataFrame, relevant: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """One row for each question of ``relevant`` (question, id): recall and precision at each k, reciprocal rank.

    ``ranking`` has (question, rank, id).  A question that finds nothing scores 0.
    """
    want = relevant.groupBy("question").agg(F.countDistinct("id").alias("wanted"))
    hits = ranking.join(relevant.distinct(), ["question", "id"]).groupBy("question")
    found = hits.agg(F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks])
    both = want.join(found, "question", "left").na.fill(0, [f"h{k}" for k in ks])
    recall = [(F.col(f"h{k}") / F.col("wanted")).alias(f"recall_{k}") for k in ks]
    precision = [(F.col(f"h{k}") / F.lit(k)).alias(f"precision_{k}") for k in ks]
    return both.select("question", *recall, *precision, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def summary(scores: DataFrame, kind: str | None = None) -> DataFrame:
    """Means of all measures, of all questions or for each kind."""
    names = [c for c in scores.columns if c not in ("question", kind)]
    grouped = scores.groupBy(kind) if kind else scores.groupBy()
    return grouped.agg(F.count("*").alias("questions"), *[F.avg(c).alias(c) for c in names])


def golden_set(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memories, questions and relevant ids of a golden data set in JSON; bad references are an error."""
    raw = spark.read.option("multiLine", True).json(path)
    memories = raw.select(F.explode("memories").alias("m")).select("m.*")
    questions = raw.select(F.explode("questions").alias("q")).select("q.*")
    relevant = questions.select(F.col("id").alias("question"), F.explode("relevant").alias("id"))
    missing = relevant.join(memories.select(F.col("key").alias("id")), "id", "left_anti")
    if not missing.isEmpty():
        raise ValueError(f"questions refer to unknown memories, such as {missing.first()['id']}")
    return memories, questions, relevant
