"""Batches of edge repairs, applied in order.

Whatever an operation touches lies between the same two memories: a retype keeps the ends, a reverse swaps them.  So the
unordered pair of ends is the group within which order matters, and groups are independent.  Edges of touched pairs and the operations are sorted
by pair and place, and a task folds them as they stream by: it holds the edges of one pair at a time, however many operations
there are on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep import schema as S
from lorekeep.sources.tables import saved

#: The operations of a batch, and how many of them one reviewed batch may hold.
REPAIRS, MOST = ("delete", "retype", "reverse"), 100
KEY = ["source_id", "target_id", "relation_type"]


def validated(ops: DataFrame, most: int | None = MOST) -> DataFrame:
    """``ops``, or a ValueError that names what is wrong: nothing is applied of a batch that is malformed.

    An op has op, source_id, target_id, relation_type, new_type and place.  Self edges, unknown types and operations, missing ends or
    places, equal places, and a reverse without the current type are errors; a retype without it is an outcome of its own.
    """
    unknown = lambda c: F.col(c).isNotNull() & ~F.col(c).isin(*S.RELATION_TYPES)
    wrong = (
        F.when(F.col("source_id").isNull() | F.col("target_id").isNull(), "an op needs both source_id and target_id")
        .when(F.col("place").isNull(), "an op needs a place")
        .when(F.col("source_id") == F.col("target_id"), "a self edge cannot exist")
        .when(F.col("op").isNull() | ~F.col("op").isin(*REPAIRS), "unknown op")
        .when(unknown("relation_type") | unknown("new_type"), "unknown relation_type")
        .when((F.col("op") == "reverse") & F.col("relation_type").isNull(), "a reverse needs relation_type")
    )
    told = ops.agg(F.count("*").alias("n"), F.count_distinct("place").alias("places"), F.min(wrong).alias("wrong")).first()
    if told["n"] == 0:
        raise ValueError("no ops: nothing to do")
    if most is not None and told["n"] > most:
        raise ValueError(f"{told['n']} ops; at most {most} for each batch")
    if told["wrong"]:
        raise ValueError(told["wrong"])
    if told["places"] < told["n"]:
        raise ValueError("ops share a place")
    return ops


def would(ops: DataFrame) -> DataFrame:
    """``ops`` with the outcome of a dry run, which looks at no edge."""
    return ops.withColumn(
        "outcome",
        F.when(F.col("op") == "reverse", "would_reverse").when((F.col("op") == "retype") & F.col("relation_type").isNotNull(), "would_retype").when(F.col("op") == "retype", "error")
        .when(F.col("relation_type").isNotNull(), "would_delete").otherwise("would_delete_all"),
    )


class Pair:
    """The edges between two memories: ids by (source, target, type).  What an id became is told when the pair is done."""

    def __init__(self) -> None:
        self.held: dict[tuple, list] = {}
        self.gone: list = []
        self.moved: set = set()

    def drop(self, key: tuple) -> None:
        self.gone += self.held.pop(key)

    def apply(self, op: str, source, target, old: str | None, new: str | None) -> tuple[str, list[str] | None]:
        """The outcome, and the types that an untyped delete removed."""
        if op == "delete" and old is None:
            types = sorted(k[2] for k in self.held if k[:2] == (source, target))
            for t in types:
                self.drop((source, target, t))
            return ("deleted" if types else "not_found"), types
        key = (source, target, old)
        if op == "retype" and (old is None or new is None):
            return "error", None
        if key not in self.held:
            return "not_found", None
        if op == "delete":
            self.drop(key)
            return "deleted", None
        to = (source, target, new) if op == "retype" else (target, source, new or old)
        if to == key:
            return "unchanged", None
        if to in self.held:
            self.drop(key)
            return "merged", None
        self.held[to] = self.held.pop(key)
        self.moved.update(self.held[to])
        return ("retyped" if op == "retype" else "reversed"), None


def repaired(relations: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The relations after a batch of ops in the order of their ``place``, and the ops with outcome and removed_types.

    Outcomes: not_found; deleted (a delete without a type takes all types of that direction, told in removed_types); unchanged; merged, where the
    new edge is there already, so the old one goes; retyped; reversed (with a new type, if given); error for a retype without both types.
    Edges keep their ids and other columns.  Edges of one key are repaired alike.
    """
    ends = lambda df: df.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), "*")
    id_type, end_type = relations.schema["edge_id"].dataType.simpleString(), relations.schema["source_id"].dataType.simpleString()
    asked = ends(ops.select("place", "op", F.col("source_id").cast(end_type).alias("source_id"), F.col("target_id").cast(end_type).alias("target_id"), "relation_type", "new_type"))
    touched = ends(relations.select("edge_id", *KEY)).join(asked.select("a", "b").distinct(), ["a", "b"], "left_semi")
    rows = asked.withColumn("edge_id", F.lit(None).cast(id_type)).unionByName(touched, allowMissingColumns=True)
    sorted_rows = rows.repartition("a", "b").sortWithinPartitions("a", "b", F.asc_nulls_first("place"), "edge_id")
    schema = f"place {ops.schema['place'].dataType.simpleString()}, edge_id {id_type}, source_id {end_type}, target_id {end_type}, relation_type string, outcome string, removed_types array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, now, types = Pair(), None, None

        def told(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [types["place"], types["edge_id"], types["source_id"], types["target_id"], pa.string(), pa.string(), pa.list_(pa.string())]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        def left() -> list[tuple]:
            out = [(None, i, None, None, None, "gone", None) for i in pair.gone]
            return out + [(None, i, *key, "moved", None) for key, held in pair.held.items() for i in held if i in pair.moved]

        for batch in batches:
            types, out = {f.name: f.type for f in batch.schema}, []
            for r in batch.to_pylist():
                if (r["a"], r["b"]) != now:
                    out += left()
                    pair, now = Pair(), (r["a"], r["b"])
                if r["place"] is None:
                    pair.held.setdefault((r["source_id"], r["target_id"], r["relation_type"]), []).append(r["edge_id"])
                else:
                    outcome, removed = pair.apply(r["op"], r["source_id"], r["target_id"], r["relation_type"], r["new_type"])
                    out.append((r["place"], None, None, None, None, outcome, removed))
            yield told(out)
        if types is not None:
            yield told(left())

    done = saved(sorted_rows.mapInArrow(run, schema), "repairs")
    fate = done.where("place IS NULL").select("edge_id", *[F.col(c).alias(f"to_{c}") for c in KEY], F.col("outcome").alias("fate"))
    both = relations.join(fate, "edge_id", "left").where("fate IS NULL OR fate = 'moved'")
    new = {c: F.when(F.col("fate").isNotNull(), F.col(f"to_{c}")).otherwise(F.col(c)).alias(c) for c in KEY}
    after = both.select(*[new.get(c, F.col(c)) for c in relations.columns])
    return after, ops.join(done.where("place IS NOT NULL").select("place", "outcome", "removed_types"), "place")
