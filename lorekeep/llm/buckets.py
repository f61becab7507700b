"""Buckets of any size, dealt over several tasks.

Rows of a bucket carry a salt; what belongs to the bucket as a whole is sent to each of its
salts.  Small buckets have one salt, so nothing is copied for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import saved, small

#: Rows of a bucket with one salt, about.
PART = 512


def salted(rows: DataFrame, item: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` (bucket, item, ...) with their ``salt``, and (bucket, salts) of the large buckets."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > PART)
    sizes = small(saved(sizes.select("bucket", F.ceil(F.col("n") / PART).alias("salts")), "sizes"))
    return rows.join(sizes, "bucket", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(item), F.col("salts")), F.lit(0).cast("long"))).drop("salts"), sizes


def dealt(rows: DataFrame, item: str) -> tuple[DataFrame, DataFrame]:
    """As ``salted``, for rows that hold the size ``k`` of their bucket: no join, and ``rows`` are computed once and saved."""
    rows = saved(rows.withColumn("salt", F.pmod(F.xxhash64(item), F.ceil(F.col("k") / PART))), "dealt")
    sizes = rows.where(F.col("k") > PART).groupBy("bucket").agg(F.ceil(F.max("k") / PART).alias("salts"))
    return rows, small(saved(sizes, "sizes"))


def to_bucket(rows: DataFrame, facts: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` joined to ``facts``, any number of them for a bucket; rows of other buckets go."""
    salts = F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1).cast("long")) - 1)
    return rows.join(facts.join(sizes, "bucket", "left").withColumn("salt", F.explode(salts)).drop("salts"), ["bucket", "salt"])


def first_rows(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each bucket: those of each salt, then those among them."""
    for by in (["bucket", "salt"], ["bucket"]):
        rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_place") <= most).drop("_place")
    return rows
