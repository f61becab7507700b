"""Changes of a corpus as pure functions from snapshots to snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import embedding_input, normalised_tag


def created(memories: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """``memories`` with new rows; confirmed only if verified, never pinned."""
    own = fresh.withColumns(
        {
            "created_at": now,
            "updated_at": now,
            "last_accessed": now,
            "last_confirmed": F.when(F.col("confidence") == "verified", now),
            "access_count": F.lit(0).cast("long"),
            "pinned": F.lit(False),
            "tags": F.array_distinct(F.transform("tags", normalised_tag)),
        }
    )
    return memories.unionByName(own, allowMissingColumns=True)


def updated(memories: DataFrame, patch: DataFrame, now: Column) -> DataFrame:
    """Rows of ``patch`` (id and any columns) applied where not null; an empty metadata clears it.

    The confirmation moves if confidence is set to verified or the title or content changes.
    """
    fields = [c for c in patch.columns if c != "id" and c in memories.columns]
    p = patch.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in fields])
    both = memories.join(p, "id", "left")
    moved = F.lit(False)
    for c in ("title", "content"):
        if c in fields:
            moved = moved | F.coalesce(F.col(f"_{c}") != F.col(c), F.lit(False))
    if "confidence" in fields:
        moved = moved | F.coalesce(F.col("_confidence") == "verified", F.lit(False))
    out = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields}
    if "metadata" in out:
        out["metadata"] = F.nullif(out["metadata"], F.lit(""))
    out |= {"updated_at": F.when(F.col("_hit"), now).otherwise(F.col("updated_at")), "last_confirmed": F.when(F.col("_hit") & moved, now).otherwise(F.col("last_confirmed"))}
    return both.select(*[out.get(c, F.col(c)).alias(c) for c in memories.columns])


def forgotten(memories: DataFrame, ids: DataFrame, now: Column | None = None) -> DataFrame:
    """The ids' confidence becomes deprecated and, with ``now``, that is an update; nothing else moves."""
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    new = {"confidence": F.when(F.col("_hit"), "deprecated").otherwise(F.col("confidence"))}
    if now is not None:
        new["updated_at"] = F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))
    return memories.join(hit, "id", "left").withColumns(new).select(*memories.columns)


def deleted(memories: DataFrame, relations: DataFrame, dependents: dict[str, DataFrame], ids: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Without the ids: memories, edges with either end among them, and rows of dependents (memory_id)."""
    gone = ids.select("id").distinct()
    edges = relations.join(gone, relations["source_id"] == gone["id"], "left_anti").join(gone, relations["target_id"] == gone["id"], "left_anti")
    rest = {name: df.join(gone.withColumnRenamed("id", "memory_id"), "memory_id", "left_anti") for name, df in dependents.items()}
    return memories.join(gone, "id", "left_anti"), edges, rest


def accessed(memories: DataFrame, log: DataFrame) -> DataFrame:
    """Access counts and times with the new rows of the log (memory_id, accessed_at)."""
    fresh = log.groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("_n"), F.max("accessed_at").alias("_last"))
    both = memories.join(fresh, "id", "left")
    return both.withColumns({"access_count": F.col("access_count") + F.coalesce("_n", F.lit(0)), "last_accessed": F.greatest("last_accessed", "_last")}).select(*memories.columns)


def touched(memories: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Only the time of the last access moves."""
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    return memories.join(hit, "id", "left").withColumn("last_accessed", F.when(F.col("_hit"), now).otherwise(F.col("last_accessed"))).select(*memories.columns)


def tagged(memories: DataFrame, tags: DataFrame, replace: bool = False) -> DataFrame:
    """``tags`` (id, tags) replace or join a memory's tags; normalised, distinct, in order."""
    fresh = tags.select("id", F.array_distinct(F.transform("tags", normalised_tag)).alias("_t"))
    none = F.array().cast("array<string>")
    new = F.col("_t") if replace else F.array_union(F.coalesce("tags", none), F.col("_t"))
    return memories.join(fresh, "id", "left").withColumn("tags", F.when(F.col("_t").isNotNull(), new).otherwise(F.col("tags"))).select(*memories.columns)


def upserted(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each key: that with the latest version, new before old on a tie."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place", "_new")


def related(relations: DataFrame, fresh: DataFrame) -> DataFrame:
    """``relations`` with new edges: no self edges, none twice."""
    key = ["source_id", "target_id", "relation_type"]
    own = fresh.where("source_id <> target_id").dropDuplicates(key).join(relations.select(*key), key, "left_anti")
    return relations.unionByName(own, allowMissingColumns=True)


def unembedded(memories: DataFrame, embeddings: DataFrame, dim: int, limit: int | None) -> DataFrame:
    """Memories without a vector of the wanted length, a batch at most; all of them without a limit."""
    have = embeddings.where(F.size("vector") == dim).select("id")
    left = memories.join(have, "id", "left_anti")
    return left if limit is None else left.orderBy("id").limit(limit)


def embedded(memories: DataFrame, embeddings: DataFrame, encode: Callable[[list[str]], list], dim: int, limit: int | None) -> DataFrame:
    """``embeddings`` with vectors of one batch of memories that have none; texts that ``encode`` fails on are left out."""
    batch = unembedded(memories, embeddings, dim, limit).select("id", embedding_input(F.col("title"), F.col("content")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = [v if v is not None and len(v) == dim else None for v in encode(frame["text"].tolist())]
            yield pd.DataFrame({"id": frame["id"], "vector": vectors}).dropna(subset=["vector"])

    kind = memories.schema["id"].dataType.simpleString()
    fresh = batch.mapInPandas(run, f"id {kind}, vector array<double>")
    old = embeddings.join(batch.select("id"), "id", "left_anti").select("id", "vector")
    return old.union(fresh)
