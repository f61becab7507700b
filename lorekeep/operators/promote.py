"""Promotion of memories to a shared corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What must not be promoted.
SECRETS = (
    r"sk-[A-Za-z0-9]{8,}",
    r"AKIA[0-9A-Z]{16}",
    r"(?i:secret_access_key)",
    r"Bearer\s+[A-Za-z0-9._-]{20,}",
    r"-----BEGIN",
    r"[a-fA-F0-9]{32,}",
    r"""password["']?\s*[:=]\s*\S""",
)
EXCLUDED_TAGS = (
    "session", "resume", "session-summary", "session-start", "session-end", "housekeeping",
    "identity", "collaboration", "communication", "journal", "reflection", "meta", "key-rotation",
)


def contains_secret(text: Column) -> Column:
    return F.coalesce(text.rlike("|".join(f"(?:{p})" for p in SECRETS)), F.lit(False))


def promotable(excluded: Sequence[str] = EXCLUDED_TAGS) -> Column:
    """Verified, without an excluded tag or anything that looks like a secret."""
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t))
    return (F.col("confidence") == "verified") & ~F.arrays_overlap(tags, F.array(*[F.lit(t) for t in excluded])) & ~contains_secret(F.col("content"))


def promoted_ids(target: DataFrame) -> DataFrame:
    """Source ids found in the provenance of the target's metadata; other metadata are passed over."""
    return target.select(F.get_json_object("metadata", "$.promoted_from.id").alias("id")).where("id IS NOT NULL AND id <> ''").distinct()


def provenance(instance: str, contributor: str, when: str) -> Column:
    own = F.struct(F.lit(instance).alias("instance"), F.col("namespace"), F.col("id").cast("string").alias("id"), F.lit(contributor).alias("contributor"), F.lit(when).alias("promoted_at"))
    return F.to_json(F.struct(own.alias("promoted_from")))


def promoted(candidates: DataFrame, target: DataFrame, instance: str, contributor: str, when: str, excluded: Sequence[str] = EXCLUDED_TAGS) -> DataFrame:
    """The promotable candidates that the target doesn't have, with their provenance as metadata."""
    there = promoted_ids(target).withColumnRenamed("id", "_there")
    fresh = candidates.where(promotable(excluded)).join(there, F.col("id").cast("string") == F.col("_there"), "left_anti")
    return fresh.withColumn("metadata", provenance(instance, contributor, when))


def report(candidates: DataFrame, target: DataFrame, excluded: Sequence[str] = EXCLUDED_TAGS) -> DataFrame:
    """One row: candidates, promotable, filtered out, already promoted, promoted."""
    there = promoted_ids(target).select(F.col("id").alias("_there"))
    both = candidates.withColumn("_ok", promotable(excluded)).join(there, F.col("id").cast("string") == F.col("_there"), "left")
    one = both.agg(F.count("*").alias("candidates"), F.count_if(F.col("_ok")).alias("promotable"), F.count_if(F.col("_ok") & F.col("_there").isNotNull()).alias("already_promoted"))
    return one.select("candidates", "promotable", (F.col("candidates") - F.col("promotable")).alias("filtered_out"), "already_promoted", (F.col("promotable") - F.col("already_promoted")).alias("promoted"))
