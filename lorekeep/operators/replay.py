"""Replaying a log of typed operations over a snapshot of memories and relations.

What an operation does to a memory depends on that memory's earlier operations alone, so the log is dealt by id and sorted by place, and a
task folds it as it streams by, one memory at a time, however many operations there are on it.  An operation that relates two memories stands in
the streams of both; each tells whether its memory was there and how often it had been deleted before, and the two answers meet
afterwards.  Memories that the log doesn't name pass by untouched, texts included.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep import schema as S
from lorekeep.operators import claims as cl
from lorekeep.operators import state
from lorekeep.sources.tables import saved

#: The operations of a log; ``relate`` has target_id and relation_type besides.
OPERATIONS = ("store", "update", "forget", "delete", "access", "touch", "tag", "relate")
FIELDS = ("namespace", "type", "title", "content", "confidence", "source", "metadata", "pinned", "tags")


@dataclass
class Replay:
    """What a log made of a snapshot."""

    memories: DataFrame
    relations: DataFrame  # new edges have the place of their operation as edge_id
    outcomes: DataFrame  # (place, outcome)
    moved: DataFrame  # (id) of live memories whose text is another than in the snapshot, new ones included
    gone: DataFrame  # (id) of memories of the snapshot that are deleted
    accesses: DataFrame  # (memory_id, accessed_at): the new rows of the access log


def metadata_of(text: str | None) -> str | None:
    """JSON objects with sorted keys, nothing for an empty text; a ValueError for anything else."""
    if not text:
        return None
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("metadata must be a JSON object")
    return json.dumps(found, sort_keys=True)


def tags_of(tags: list[str] | None) -> list[str]:
    named = (re.sub(r"\s+", "-", t.strip().lower()) for t in tags or [] if t and t.strip())
    return list(dict.fromkeys(named))


class Memory:
    """One memory on its way through the log; ``row`` is None while there is none."""

    def __init__(self, row: dict | None, columns: list[str]) -> None:
        self.row, self.columns = row, columns
        self.first = None if row is None else (row.get("title"), row.get("content"))
        self.deletions = 0

    def apply(self, op: str, at: datetime, o: dict) -> str:
        if o["type"] is not None and o["type"] not in S.MEMORY_TYPES or o["confidence"] is not None and o["confidence"] not in S.CONFIDENCE_RANK:
            return "error"
        if op == "store":
            return self.store(at, o)
        if op not in OPERATIONS:
            return "error"
        if self.row is None:
            return "not_found"
        if op == "delete":
            self.row, self.deletions = None, self.deletions + 1
            return "deleted"
        if op == "access":
            self.row |= {"access_count": (self.row["access_count"] or 0) + 1, "last_accessed": at}
            return "accessed"
        if op == "touch":
            self.row["last_accessed"] = at
            return "touched"
        if op == "tag":
            self.row["tags"] = list(dict.fromkeys([*(self.row["tags"] or []), *tags_of(o["tags"])]))
            return "tagged"
        if op == "forget":
            self.row |= {"confidence": "deprecated", "updated_at": at}
            return "deprecated"
        return self.update(at, o)

    def store(self, at: datetime, o: dict) -> str:
        if self.row is not None:
            return "exists"
        try:
            metadata = metadata_of(o["metadata"])
        except ValueError:
            return "error"
        if o["title"] is None or o["content"] is None or o["type"] is None or o["namespace"] is None:
            return "error"
        confidence = o["confidence"] or "inferred"
        made = {
            **{f: o[f] for f in FIELDS}, "confidence": confidence, "metadata": metadata, "created_at": at, "updated_at": at, "last_accessed": at,
            "last_confirmed": at if confidence == "verified" else None, "access_count": 0, "pinned": False, "tags": tags_of(o["tags"]), "id": o["id"],
        }
        self.row = {c: made.get(c) for c in self.columns}
        return "stored"

    def update(self, at: datetime, o: dict) -> str:
        new = {f: o[f] for f in FIELDS if o[f] is not None and f in self.columns and f not in ("namespace", "source")}
        if "metadata" in new:
            try:
                new["metadata"] = metadata_of(new["metadata"])  # an empty text clears it
            except ValueError:
                return "error"
        if "tags" in new:
            new["tags"] = tags_of(new["tags"])
        text = any(new.get(f, self.row[f]) != self.row[f] for f in ("title", "content"))
        self.row |= new | {"updated_at": at}
        if text or o["confidence"] == "verified":  # restating a text confirms it; other changes say nothing of its truth
            self.row["last_confirmed"] = at
        return "updated"

    @property
    def moved(self) -> bool:
        return self.row is not None and (self.row.get("title"), self.row.get("content")) != self.first


def replayed(memories: DataFrame, relations: DataFrame, log: DataFrame) -> Replay:
    """``log`` (place, at, op, id, the FIELDS, target_id, relation_type) over a snapshot, in the order of its unique places.

    Outcomes: stored; exists, for a store of an id that is there, and a relate of an edge that is; updated, deprecated, deleted, accessed, touched, tagged,
    related; not_found; error, for what isn't valid (values outside their domains, metadata that is no JSON object, a store without namespace, type, title or content, a self edge).  What isn't
    valid changes nothing.  A deletion takes the memory's edges with it; an id may be stored again.
    """
    id_type, columns = memories.schema["id"].dataType.simpleString(), memories.columns
    own = saved(log.select("place", "at", "op", F.col("id").cast(id_type).alias("id"), *FIELDS, F.col("target_id").cast(id_type).alias("target_id"), "relation_type"), "log")
    sides = own.select("id", "place", F.lit("s").alias("side"), F.struct(own.columns).alias("o"))
    sides = sides.union(own.where("op = 'relate'").select(F.col("target_id").alias("id"), "place", F.lit("t"), F.struct(own.columns)))
    named = sides.select("id").distinct()
    snapshot = memories.join(named, "id", "left_semi").select("id", F.struct(*columns).alias("m"))
    rows = sides.unionByName(snapshot, allowMissingColumns=True).select("id", "place", "side", "o", "m")
    place_type, m_type = log.schema["place"].dataType.simpleString(), rows.schema["m"].dataType.simpleString()
    schema = f"id {id_type}, kind string, place {place_type}, side string, outcome string, alive boolean, deletions int, moved boolean, known boolean, m {m_type}"
    names = [x.name for x in memories.sparkSession.createDataFrame([], schema).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, now, known, kinds, out = None, None, False, None, []

        def ended() -> None:
            if memory is not None:
                out.append((now, "row", None, None, None, memory.row is not None, memory.deletions, memory.moved, known, memory.row))

        for batch in batches:
            if kinds is None:
                of = {f.name: f.type for f in batch.schema}
                kinds = [of["id"], pa.string(), of["place"], pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.bool_(), pa.bool_(), of["m"]]
            for r in batch.to_pylist():
                if memory is None or r["id"] != now:
                    ended()
                    now, known = r["id"], r["place"] is None
                    memory = Memory(r["m"] if known else None, columns)
                if r["place"] is None:
                    continue
                o = r["o"]
                if o["op"] == "relate":
                    wrong = o["id"] == o["target_id"] or o["relation_type"] not in S.RELATION_TYPES
                    out.append((now, "end", r["place"], r["side"], "error" if wrong else None, memory.row is not None, memory.deletions, None, None, None))
                else:
                    out.append((now, "op", r["place"], None, memory.apply(o["op"], o["at"], o), None, None, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names=names)
            out.clear()
        ended()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    done = saved(rows.repartition("id").sortWithinPartitions("id", F.asc_nulls_first("place"), "side").mapInArrow(run, schema), "replay")
    ends = done.where("kind = 'row'")
    after = memories.join(named, "id", "left_anti").unionByName(ends.where("alive").select("m.*"))

    s, t = (done.where(f"kind = 'end' AND side = '{x}'").select("place", F.col("id").alias(f"{x}_id"), "outcome", F.col("alive").alias(f"{x}_alive"), F.col("deletions").alias(f"{x}_del")) for x in "st")
    met = s.join(t.drop("outcome"), "place", "left").join(own.select("place", "relation_type", "at"), "place")
    met = met.withColumn("there", F.col("outcome").isNull() & F.col("s_alive") & F.coalesce("t_alive", F.lit(False)))
    edge = ["source_id", "target_id", "relation_type"]
    fresh = met.where("there").select(F.col("s_id").alias("source_id"), F.col("t_id").alias("target_id"), "relation_type", "s_del", "t_del", "place", "at")
    old = relations.select(*edge).distinct().withColumn("known", F.lit(True))
    # the first of its kind between two deletions of either end makes the edge
    first = fresh.groupBy(*edge, "s_del", "t_del").agg(F.min_by(F.struct("place", "at"), "place").alias("p"))
    first = first.join(old, edge, "left").withColumn("new", F.col("known").isNull() | (F.col("s_del") + F.col("t_del") > 0)).select(*edge, "s_del", "t_del", "p.place", "p.at", "new")
    makers = first.where("new").select("place", F.lit(True).alias("makes"))
    told = met.join(makers, "place", "left").select("place", F.when(F.col("outcome").isNotNull(), F.col("outcome")).when(~F.col("there"), "not_found").when(F.col("makes"), "related").otherwise("exists").alias("outcome"))
    outcomes = done.where("kind = 'op'").select("place", "outcome").union(told)

    last = saved(ends.select("id", "alive", "deletions"), "ends")
    side = lambda df, c, n: df.join(last.select(F.col("id").alias(c), F.col("alive").alias(f"{n}_now"), F.col("deletions").alias(f"{n}_end")), c, "left")
    kept = side(side(relations, "source_id", "s"), "target_id", "t").where("coalesce(s_end, 0) = 0 AND coalesce(t_end, 0) = 0").select(*relations.columns)
    stay = side(side(first.where("new"), "source_id", "s"), "target_id", "t").where("s_now AND t_now AND s_end = s_del AND t_end = t_del")
    made = {"edge_id": F.col("place").cast(relations.schema["edge_id"].dataType) if "edge_id" in relations.columns else None, "created_at": F.col("at")}
    new = stay.select(*[F.col(c) if c in edge else made[c].alias(c) if made.get(c) is not None else F.lit(None).cast(relations.schema[c].dataType).alias(c) for c in relations.columns])
    hits = done.where("kind = 'op' AND outcome = 'accessed'").join(own.select("place", "at"), "place").select(F.col("id").alias("memory_id"), F.col("at").alias("accessed_at"))
    return Replay(after, kept.unionByName(new), outcomes, ends.where("moved").select("id"), ends.where("known AND (NOT alive OR deletions > 0)").select("id"), hits)


def claims_after(old: DataFrame, done: Replay, repo: Column, aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The claims after a replay, and what became of those of moved memories; only texts that moved are read."""
    deleted = done.gone.join(done.memories.select("id"), "id", "left_anti")
    return cl.synchronised(old, done.memories.join(done.moved, "id", "left_semi"), done.moved, deleted, repo, aliases)


def vectors_after(embeddings: DataFrame, done: Replay, encode: Callable[[list[str]], list], dim: int) -> DataFrame:
    """The vectors after a replay: those of moved and deleted memories go, and moved ones are encoded anew."""
    stale = done.moved.union(done.gone).distinct()
    left = embeddings.join(stale, "id", "left_anti")
    texts = done.memories.join(done.moved, "id", "left_semi")
    return state.embedded(texts, left, encode, dim, None)
