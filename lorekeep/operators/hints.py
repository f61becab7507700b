"""Hints on writing: near-duplicates of a new memory, and memories worth a relation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep import schema as S
from lorekeep.operators import filters, graph, search
from lorekeep.operators.cluster import similar_to
from lorekeep.operators.postings import Index


def candidates(corpus: DataFrame, namespace: str, text: str, now: Column, pool: int, embeddings: DataFrame | None = None, vector: Sequence[float] | None = None, index: Index | None = None) -> DataFrame:
    """The first ``pool`` of a namespace's active memories by fused relevance."""
    kept = filters.select_memories(corpus, [namespace])
    return search.hybrid(corpus, kept, embeddings, text, vector, now, pool, index=index).drop("score")


def find_similar(corpus: DataFrame, namespace: str, text: str, now: Column, embeddings: DataFrame | None = None, vector: Sequence[float] | None = None, limit: int = S.HINTS, index: Index | None = None) -> DataFrame:
    """Memories close enough to a new text to be merged into: those of a small pool past the duplicates' gate."""
    if not text.strip():
        return corpus.withColumn("similarity", F.lit(0.0)).limit(0)
    pool = candidates(corpus, namespace, text, now, limit * S.HINT_POOL, embeddings, vector, index)
    return similar_to(pool, embeddings, text, list(vector) if vector is not None else None, (S.DEDUPE_COSINE, S.DEDUPE_JACCARD), limit)


def suggest_relations(corpus: DataFrame, relations: DataFrame, namespace: str, text: str, now: Column, memory_id=None, exclude: Sequence = (), embeddings: DataFrame | None = None, vector: Sequence[float] | None = None, limit: int = S.HINTS, index: Index | None = None) -> DataFrame:
    """Memories worth examining for a relation: past the looser gate, without the memory itself, those excluded and its neighbours.

    The pool grows by what is skipped, so it still has candidates; only their number reaches the driver.
    """
    if not text.strip():
        return corpus.withColumn("similarity", F.lit(0.0)).limit(0)
    kind = corpus.schema["id"].dataType
    given = [i for i in (memory_id, *exclude) if i is not None]
    skip = corpus.sparkSession.createDataFrame([(i,) for i in given], corpus.select("id").schema)
    if memory_id is not None:
        skip = skip.union(graph.endpoints(relations).where(F.col("id") == F.lit(memory_id).cast(kind)).select(F.col("other").alias("id")))
    skip = skip.distinct()
    pool = candidates(corpus, namespace, text, now, limit * S.HINT_POOL + skip.count(), embeddings, vector, index).join(skip, "id", "left_anti")
    return similar_to(pool, embeddings, text, list(vector) if vector is not None else None, (S.RELATE_COSINE, S.RELATE_JACCARD), limit)
