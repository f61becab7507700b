"""Composable predicates over memories; each takes and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep import schema as S
from lorekeep.functions.text import normalised_tag
from lorekeep.operators.claims import contradicted, in_mode


def with_all_tags(df: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Rows that have every one of the (normalised) tags."""
    if not tags:
        return df
    wanted = F.array_distinct(F.array(*[normalised_tag(F.lit(t)) for t in tags]))
    return df.where(F.size(F.array_except(wanted, F.coalesce("tags", F.array().cast("array<string>")))) == 0)


def at_least(df: DataFrame, confidence: str) -> DataFrame:
    lowest = S.CONFIDENCE_RANK[confidence]
    return df.where(F.col("confidence").isin([c for c, r in S.CONFIDENCE_RANK.items() if r >= lowest]))


def select_memories(
    df: DataFrame,
    namespaces: Sequence[str] | None = None,
    type: str | None = None,
    min_confidence: str | None = None,
    include_deprecated: bool = False,
    created_after: str | None = None,
    created_before: str | None = None,
    tags: Sequence[str] | None = None,
    claims: tuple[DataFrame, str] | None = None,
    orphans_of: DataFrame | None = None,
) -> DataFrame:
    """All given conditions at once; date bounds are inclusive instants.

    ``claims`` are the corpus's claims and a mode of ``in_mode``; with the relations as ``orphans_of`` only memories without an edge stay.
    """
    every = df
    if namespaces:
        df = df.where(F.col("namespace").isin(list(namespaces)))
    if type:
        df = df.where(F.col("type") == type)
    if not include_deprecated:
        df = df.where(F.col("confidence") != "deprecated")
    if min_confidence:
        df = at_least(df, min_confidence)
    if created_after:
        df = df.where(F.col("created_at") >= F.lit(created_after).cast("timestamp_ntz"))
    if created_before:
        df = df.where(F.col("created_at") <= F.lit(created_before).cast("timestamp_ntz"))
    df = with_all_tags(df, tags or ())
    if claims is not None:
        known, mode = claims
        if mode == "contradicted":  # by any memory of its namespace, not only by those that pass the other conditions
            against = contradicted(known, every.where("confidence <> 'deprecated'").select("id"))
            df = df.join(against.select(F.col("memory_id").alias("id")), "id", "left_semi")
        else:
            df = in_mode(df, known, mode)
    return df if orphans_of is None else orphans(df, orphans_of)


def orphans(df: DataFrame, relations: DataFrame) -> DataFrame:
    """Memories that no edge touches: an anti join with the union of the endpoints."""
    ends = relations.select(F.col("source_id").alias("id")).union(relations.select(F.col("target_id").alias("id"))).distinct()
    return df.join(ends, "id", "left_anti")


def containing(df: DataFrame, text: str, types: Sequence[str] = (), namespaces: Sequence[str] = (), confidences: Sequence[str] = ()) -> DataFrame:
    """Case-insensitive text in title, content or tags, within sets of types, namespaces and confidences."""
    hay = F.lower(F.concat_ws(" ", "title", "content", F.array_join("tags", " ")))
    df = df.where(hay.contains(text.lower()))
    for column, values in (("type", types), ("namespace", namespaces), ("confidence", confidences)):
        if values:
            df = df.where(F.col(column).isin(list(values)))
    return df
