"""The namespaces of a corpus: resolve, create, update, delete."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT = "default"


def resolved(name: str | None, environment: Mapping[str, str], name_key: str, path_key: str) -> str:
    """The given name, else the environment's, else the last part of the environment's path, else the default."""
    path = (environment.get(path_key) or "").rstrip("/")
    return next((n.strip() for n in (name, environment.get(name_key), os.path.basename(path)) if n and n.strip()), DEFAULT)


def for_reading(namespaces: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rows of the names; a name that isn't there is an error, never created."""
    wanted = namespaces.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in dict.fromkeys(names)])).alias("name"))
    unknown = [r["name"] for r in wanted.join(namespaces, "name", "left_anti").orderBy("name").collect()]
    if unknown:
        raise ValueError(f"unknown namespaces: {', '.join(unknown)}")
    return namespaces.join(F.broadcast(wanted), "name", "left_semi").orderBy("name")


def with_names(namespaces: DataFrame, names: DataFrame) -> DataFrame:
    """``namespaces`` and those of ``names`` (name) that aren't there yet; null and empty names never are."""
    fresh = names.where("name <> ''").select("name").distinct().join(namespaces, "name", "left_anti")
    return namespaces.unionByName(fresh, allowMissingColumns=True)


def updated(namespaces: DataFrame, patch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The namespaces with ``patch`` (name and any columns) applied where not null, and the names whose default repo changes.

    The claims of those namespaces are to be derived again.
    """
    fields = [c for c in patch.columns if c != "name" and c in namespaces.columns]
    both = namespaces.join(patch.select("name", *[F.col(c).alias(f"_{c}") for c in fields]), "name", "left")
    out = both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in namespaces.columns])
    if "default_repo" not in fields:
        return out, namespaces.select("name").limit(0)
    return out, both.where(F.col("_default_repo").isNotNull() & ~F.col("_default_repo").eqNullSafe(F.col("default_repo"))).select("name")


def deleted(namespaces: DataFrame, memories: DataFrame, names: DataFrame, cascade: bool = False) -> tuple[DataFrame, DataFrame]:
    """The namespaces and memories that are left, and for each name what became of it is in ``outcome_of``.

    The default namespace stays, and so does one that holds memories unless ``cascade`` takes them along.
    """
    gone = outcome_of(namespaces, memories, names, cascade).where("outcome = 'deleted'").select("name")
    return namespaces.join(gone, "name", "left_anti"), memories.join(gone.withColumnRenamed("name", "namespace"), "namespace", "left_anti").select(*memories.columns)


def outcome_of(namespaces: DataFrame, memories: DataFrame, names: DataFrame, cascade: bool = False) -> DataFrame:
    """(name, n, outcome): deleted, protected, not_empty or not_found, with the number of memories."""
    held = memories.groupBy(F.col("namespace").alias("name")).agg(F.count("*").alias("n"))
    both = names.select("name").distinct().join(namespaces.select("name", F.lit(True).alias("there")), "name", "left").join(held, "name", "left")
    n = F.coalesce("n", F.lit(0))
    outcome = F.when(F.col("there").isNull(), "not_found").when(F.col("name") == DEFAULT, "protected").when((n > 0) & ~F.lit(cascade), "not_empty").otherwise("deleted")
    return both.select("name", n.alias("n"), outcome.alias("outcome"))


def stamped(memories: DataFrame, namespaces: DataFrame) -> DataFrame:
    """``memories`` (namespace_id) with the namespace's name, its id where it has none."""
    names = namespaces.select(F.col("id").alias("namespace_id"), F.col("name").alias("namespace"))
    return memories.drop("namespace").join(names, "namespace_id", "left").withColumn("namespace", F.coalesce("namespace", "namespace_id"))


def tags_of(memories: DataFrame) -> DataFrame:
    """(id, tag) of every memory, each tag once."""
    return memories.select("id", F.explode(F.array_distinct("tags")).alias("tag"))


def tag_table(tags: DataFrame, memory_tags: DataFrame) -> DataFrame:
    """The known tags (tag) that a memory still has, and those of ``memory_tags`` (id, tag) that weren't known; sorted names, no orphans."""
    return tags.select("tag").union(memory_tags.select("tag")).distinct().join(memory_tags, "tag", "left_semi").orderBy("tag")
