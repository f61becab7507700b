"""Listings without a query: ordered, scored, by id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.scoring import composite

ORDERS = {"created": "created_at", "accessed": "last_accessed"}


def by_column(df: DataFrame, sort_by: str, limit: int, now: Column) -> DataFrame:
    """The latest ``limit`` by a time column, ties by id, with their score."""
    return df.orderBy(F.col(ORDERS[sort_by]).desc(), "id").limit(limit).withColumn("score", composite(F.lit(0.5), now))


def by_score(df: DataFrame, limit: int, now: Column, weights: dict[str, float] | None = None) -> DataFrame:
    """The best ``limit`` by composite score at neutral relevance, ties by id."""
    return df.withColumn("score", composite(F.lit(0.5), now, weights)).orderBy(F.desc("score"), "id").limit(limit)


def paged(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> tuple[int, DataFrame]:
    """How many rows there are, and those of one page."""
    return df.count(), paged(df, order, offset, limit)


def by_ids(spark: SparkSession, df: DataFrame, ids: Sequence) -> tuple[DataFrame, DataFrame]:
    """The rows with these ids in the order asked for, and the ids that are missing."""
    kind = df.schema["id"].dataType.simpleString()
    asked = spark.range(1).select(F.posexplode(F.array(*[F.lit(i) for i in ids]).cast(f"array<{kind}>")).alias("position", "id"))
    asked = asked.groupBy("id").agg(F.min("position").alias("position"))
    found = df.join(F.broadcast(asked), "id").orderBy("position")
    return found, asked.join(df.select("id").distinct(), "id", "left_anti").select("id", "position")
