"""The typed relation graph: degrees, neighbours, repairs, shared tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep import schema as S
from lorekeep.functions.scoring import confidence_rank, reference_time


def endpoints(relations: DataFrame) -> DataFrame:
    """(id, other, relation_type, edge_id, direction): every edge from both of its ends."""
    out = relations.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "relation_type", "edge_id", F.lit("out").alias("direction"))
    return out.union(relations.select("target_id", "source_id", "relation_type", "edge_id", F.lit("in")))


def degrees(relations: DataFrame) -> DataFrame:
    return endpoints(relations).groupBy("id").agg(F.count("*").alias("degree"))


def metrics(memories: DataFrame, relations: DataFrame, cap: int = S.OVER_CAP) -> DataFrame:
    """One row: edges, edges for each memory, high-signal share, orphans, memories over the cap."""
    n = memories.agg(F.count("*").alias("memories"))
    e = relations.agg(F.count("*").alias("edges"), F.count_if(~F.col("relation_type").isin(*S.LOW_SIGNAL)).alias("high_signal"))
    d = degrees(relations).join(memories.select("id"), "id", "left_semi").agg(F.count("*").alias("linked"), F.count_if(F.col("degree") > cap).alias("over_cap"))
    rate = lambda a, b, digits: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), digits)).otherwise(0.0)
    one = F.broadcast(n).join(F.broadcast(e)).join(F.broadcast(d)).withColumn("orphans", F.col("memories") - F.col("linked"))
    return one.select("memories", "edges", rate("edges", "memories", 2).alias("edges_per_memory"), "high_signal", rate("high_signal", "edges", 3).alias("high_signal_ratio"), "orphans", rate("orphans", "memories", 3).alias("orphan_ratio"), "over_cap")


def orphan_sample(orphans: DataFrame, limit: int) -> DataFrame:
    return orphans.orderBy(confidence_rank().desc(), F.desc("access_count"), reference_time().desc(), "id").limit(limit)


def list_edges(memories: DataFrame, relations: DataFrame, namespace: str | None = None, relation_type: str | None = None, memory_id=None) -> DataFrame:
    """Edges with titles, namespaces and degrees of both ends."""
    deg = degrees(relations)
    own = memories.select("id", "title", "namespace")
    side = lambda p: own.join(deg, "id", "left").select(F.col("id").alias(f"{p}_id"), F.col("title").alias(f"{p}_title"), F.col("namespace").alias(f"{p}_namespace"), F.coalesce("degree", F.lit(0)).alias(f"{p}_degree"))
    df = relations if relation_type is None else relations.where(F.col("relation_type") == relation_type)
    if memory_id is not None:
        df = df.where((F.col("source_id") == memory_id) | (F.col("target_id") == memory_id))
    df = df.join(side("source"), "source_id").join(side("target"), "target_id")
    if namespace is not None:
        df = df.where((F.col("source_namespace") == namespace) | (F.col("target_namespace") == namespace))
    return df


def spread(memories: DataFrame, relations: DataFrame, seeds: DataFrame, per_seed: int = S.SPREAD_PER_SEED, total: int = S.SPREAD_TOTAL) -> DataFrame:
    """(question, position, id): the dampened neighbours of many questions' seeds (question, place, id) at once.

    Each seed in order of its place gives its best few neighbours not seen before, up to a total for the question; a question's seeds are seen from the start.
    Neighbours are ranked by confidence, fewest edges, latest anchor and largest id; parallel edges count once.  A seed is ranked once,
    whatever the number of questions, and no more of its neighbours go on than could still be taken after all earlier picks; the picks
    are a fold over a question's seeds.  An id given twice is a seed at its first place.
    """
    own = seeds.groupBy("question", "id").agg(F.min("place").alias("place"))
    most = own.groupBy("question").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    asked = own.select(F.col("id").alias("seed")).distinct()
    ends = endpoints(relations).select(F.col("id").alias("seed"), F.col("other").alias("id")).join(asked, "seed", "left_semi").distinct()
    near = ends.join(memories.select("id", confidence_rank().alias("rank"), reference_time().alias("anchor")), "id").join(degrees(relations), "id")
    order = Window.partitionBy("seed").orderBy(F.desc("rank"), F.asc("degree"), F.desc("anchor"), F.desc("id"))
    best = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most + total + per_seed)
    lists = best.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("n", "id"))).alias("l")).select("seed", F.col("l.id").alias("near"))
    kind = memories.schema["id"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    each = own.join(lists, F.col("id") == F.col("seed"), "left").select("question", "place", "id", F.coalesce("near", none).alias("near"))
    held = each.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("place", "id", "near"))).alias("seeds"))

    def take(state: Column, seed: Column) -> Column:
        fresh = F.filter(seed["near"], lambda x: ~F.array_contains(state["seen"], x))
        mine = F.slice(fresh, 1, F.least(F.lit(per_seed), F.lit(total) - F.size(state["out"])))
        return F.struct(F.concat(state["seen"], mine).alias("seen"), F.concat(state["out"], mine).alias("out"))

    start = F.struct(F.col("seeds.id").alias("seen"), none.alias("out"))
    return held.select("question", F.posexplode(F.aggregate("seeds", start, take)["out"]).alias("position", "id"))


def neighbours(memories: DataFrame, relations: DataFrame, seeds: Sequence, per_seed: int = S.SPREAD_PER_SEED, total: int = S.SPREAD_TOTAL) -> list:
    """Ids of the dampened neighbours of one question's seeds, in order."""
    kind = memories.schema["id"].dataType.simpleString()
    given = memories.sparkSession.createDataFrame([(0, i, s) for i, s in enumerate(seeds)], f"question int, place int, id {kind}")
    return [r["id"] for r in spread(memories, relations, given, per_seed, total).orderBy("position").collect()]


def one_seed_neighbours(memories: DataFrame, relations: DataFrame, per_seed: int = S.SPREAD_PER_SEED) -> DataFrame:
    """(seed, place, id) for every memory as the only seed of a spread."""
    ends = endpoints(relations).select(F.col("id").alias("seed"), F.col("other").alias("id")).distinct().where("seed <> id")
    near = ends.join(memories.select("id", confidence_rank().alias("rank"), reference_time().alias("anchor")), "id").join(degrees(relations), "id")
    order = Window.partitionBy("seed").orderBy(F.desc("rank"), F.asc("degree"), F.desc("anchor"), F.desc("id"))
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_seed).select("seed", "place", "id")


def without_edges(relations: DataFrame, gone: DataFrame) -> DataFrame:
    """``relations`` without those that ``gone`` (source_id, target_id, relation_type) names; a null type stands for all types in that direction."""
    key = ["source_id", "target_id"]
    every, one = gone.where("relation_type IS NULL").select(*key).distinct(), gone.where("relation_type IS NOT NULL").select(*key, "relation_type").distinct()
    return relations.join(every, key, "left_anti").join(one, [*key, "relation_type"], "left_anti")


def retyped(relations: DataFrame, old: str, new: str) -> DataFrame:
    """Edges with (outcome): ``old`` becomes ``new`` where that edge isn't there yet, else it is merged into it."""
    there = relations.where(F.col("relation_type") == new).select("source_id", "target_id", F.lit(True).alias("there")).distinct()
    both = relations.join(there, ["source_id", "target_id"], "left")
    hit = F.col("relation_type") == old
    outcome = F.when(~hit, "unchanged").when(F.col("there"), "merged").otherwise("retyped")
    return both.select("edge_id", "source_id", "target_id", F.when(hit, F.lit(new)).otherwise(F.col("relation_type")).alias("relation_type"), outcome.alias("outcome"))


def reversed_edges(relations: DataFrame, kind: str) -> DataFrame:
    """Edges of one type turned round, merged where the turned edge is there already."""
    there = relations.where(F.col("relation_type") == kind).select(F.col("source_id").alias("target_id"), F.col("target_id").alias("source_id"), F.lit(True).alias("there")).distinct()
    hit = relations.where(F.col("relation_type") == kind).join(there, ["source_id", "target_id"], "left")
    return hit.select("edge_id", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "relation_type", F.when(F.col("there"), "merged").otherwise("reversed").alias("outcome"))


def induced(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids``."""
    own = ids.select("id")
    return relations.join(own, relations["source_id"] == own["id"], "left_semi").join(own, relations["target_id"] == own["id"], "left_semi")


def tag_classes(memories: DataFrame) -> DataFrame:
    """(id, class, members, tags) for every memory: its class has the same set of tags and the name of its smallest id."""
    own = memories.select("id", F.sort_array(F.array_distinct("tags")).alias("tags"))
    named = own.groupBy(F.col("tags").alias("set")).agg(F.min("id").alias("class"), F.count("*").alias("members"))
    return own.join(named, F.col("tags").eqNullSafe(F.col("set"))).select("id", "class", "members", "tags")


def class_links(classes: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, shared, pairs): classes whose memories share at least ``least`` tags, and how many pairs of memories that links.

    A class of several memories is linked to itself.  Joined on pairs of tags, not on single ones, and one row
    stands for a class: no memories meet.
    """
    keyed = classes.where("id = class").select("class", "members", "tags")
    pairs = F.flatten(F.transform("tags", lambda x, i: F.transform(F.slice("tags", i + 2, F.size("tags")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    by = keyed.select("class", "members", "tags", F.explode(pairs if least >= 2 else F.col("tags")).alias("key"))
    left, right = (by.select(F.col("class").alias(c), F.col("members").alias("n" + c), F.col("tags").alias("t" + c), "key") for c in "ab")
    met = left.join(right, "key").where("a < b").select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("shared"), (F.col("na") * F.col("nb")).alias("pairs")).distinct()
    own = keyed.where("members > 1").select(F.col("class").alias("a"), F.col("class").alias("b"), F.size("tags").alias("shared"), F.expr("members * (members - 1) div 2").alias("pairs"))
    return met.union(own).where(F.col("shared") >= least)


def shared_tag_links(memories: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, shared): pairs of memories that share at least ``least`` tags.

    The pairs themselves, written out from the links of classes; their number grows with the square of a class.
    """
    classes = tag_classes(memories)
    left, right = (classes.select(F.col("class").alias(c), F.col("id").alias("i" + c)) for c in "ab")
    met = class_links(classes, least).join(left, "a").join(right, "b").where("a <> b OR ia < ib")
    return met.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "shared")


def adjacency(relations: DataFrame) -> DataFrame:
    return endpoints(relations).groupBy("id").agg(F.sort_array(F.collect_set("other")).alias("neighbours"))
