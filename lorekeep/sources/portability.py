"""Export and import of a corpus as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import schema as S


def export_rows(memories: DataFrame, relations: DataFrame, namespace: str | None = None, include_deprecated: bool = True) -> tuple[DataFrame, DataFrame]:
    """The memories to export and the edges with both ends among them."""
    own = memories if namespace is None else memories.where(F.col("namespace") == namespace)
    own = own if include_deprecated else own.where("confidence <> 'deprecated'")
    ids = own.select("id")
    edges = relations.join(ids, relations["source_id"] == ids["id"], "left_semi").join(ids, relations["target_id"] == ids["id"], "left_semi")
    return own, edges


def export_lines(memories: DataFrame, relations: DataFrame, path: str) -> None:
    """Write memories and edges as JSON lines below ``path``; any size, in parallel."""
    memories.write.mode("overwrite").json(f"{path}/memories")
    relations.write.mode("overwrite").json(f"{path}/relations")


def export_document(memories: DataFrame, relations: DataFrame, exported_at: str) -> DataFrame:
    """One row with the whole export as one JSON value (format version 1); for corpora that fit one."""
    rows = memories.agg(F.array_sort(F.collect_list(F.struct("created_at", "id", F.struct(*memories.columns).alias("m")))).alias("r")).select(F.transform("r", lambda x: x["m"]).alias("memories"))
    names = memories.select(F.col("namespace").alias("name")).distinct().agg(F.array_sort(F.collect_list(F.struct("name"))).alias("namespaces"))
    edges = relations.agg(F.array_sort(F.collect_list(F.struct(*relations.columns))).alias("relations"))
    one = F.broadcast(rows).join(F.broadcast(names)).join(F.broadcast(edges))
    return one.select(F.to_json(F.struct(F.lit(1).alias("format_version"), F.lit(exported_at).alias("exported_at"), "namespaces", "memories", "relations")).alias("export"))


def read_lines(spark: SparkSession, path: str, memories, relations) -> tuple[DataFrame, DataFrame]:
    """What ``export_lines`` wrote, with the given schemas."""
    return spark.read.schema(memories).json(f"{path}/memories"), spark.read.schema(relations).json(f"{path}/relations")


def valid(memories: DataFrame) -> DataFrame:
    """Rows whose type and confidence are known."""
    return memories.where(F.col("type").isin(*S.MEMORY_TYPES) & F.col("confidence").isin(*S.CONFIDENCE_RANK))


def imported(memories: DataFrame, relations: DataFrame, new_memories: DataFrame, new_relations: DataFrame, on_conflict: str = "skip") -> tuple[DataFrame, DataFrame]:
    """Both corpora as one: ids that are there already are skipped or replaced.

    A replaced memory loses its old edges, as if it had been deleted first.  An unknown type or confidence is an error.
    """
    if on_conflict not in ("skip", "replace"):
        raise ValueError(f"unknown on_conflict: {on_conflict}")
    if not new_memories.exceptAll(valid(new_memories)).isEmpty():
        raise ValueError("unknown type or confidence")
    fresh = new_memories.dropDuplicates(["id"])
    if on_conflict == "skip":
        fresh, kept, edges = fresh.join(memories.select("id"), "id", "left_anti"), memories, relations
    else:
        ids = fresh.select("id")
        kept = memories.join(ids, "id", "left_anti")
        edges = relations.join(ids, relations["source_id"] == ids["id"], "left_anti").join(ids, relations["target_id"] == ids["id"], "left_anti")
    every = kept.unionByName(fresh, allowMissingColumns=True)
    ids = every.select("id")
    key = ["source_id", "target_id", "relation_type"]
    more = new_relations.dropDuplicates(key).join(edges.select(*key), key, "left_anti")
    more = more.join(ids, more["source_id"] == ids["id"], "left_semi").join(ids, more["target_id"] == ids["id"], "left_semi")
    return every, edges.unionByName(more, allowMissingColumns=True)
