"""Similar memories: gates, near-duplicate clusters and their consolidation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep import schema as S
from lorekeep.functions.scoring import confidence_rank
from lorekeep.functions.text import jaccard, tokens
from lorekeep.operators.search import cosine
from lorekeep.sources.tables import saved

#: Vectors of a block, and bytes of vectors in a part of the blocks; a task compares two parts, block by block.
BLOCK, PART = 1024, 64 << 20
#: Pivots at most, the sample that they are chosen from, and bins of the angle to the nearest one.
PIVOTS, SAMPLE, BINS = 48, 4096, 2048
STRATEGIES = ("merge", "summarize", "deduplicate")


def commonest_length(embeddings: DataFrame) -> tuple[int, int]:
    """The commonest length of vectors and how many have it; 0 and 0 if there are none."""
    r = embeddings.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    return (r["dim"], r["n"]) if r else (0, 0)


def chosen_pivots(own: DataFrame, most: int) -> np.ndarray:
    """Up to ``most`` unit vectors far from one another, out of a sample of bounded size."""
    rows = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()
    v = np.array([r["vector"] for r in rows], float)
    v = v[np.isfinite(v).all(axis=1)]
    norm = np.sqrt(np.square(v).sum(axis=1))
    v = v[norm > 0] / norm[norm > 0][:, None]
    picked, near = [], np.full(len(v), -np.inf)
    while len(picked) < min(most, len(v)):
        picked.append(int(np.argmin(near)) if picked else 0)
        near = np.maximum(near, v @ v[picked[-1]])
        if near.min() > 1 - 1e-12:
            break
    return v[picked]


def in_cells(embeddings: DataFrame, dim: int, pivots: np.ndarray) -> DataFrame:
    """(id, vector, cell, bin): unit vectors with the nearest pivot, which is the cell, and the angle to it; zero vectors go."""
    own = embeddings.where(F.size("vector") == dim).select("id", F.col("vector").cast("array<double>").alias("vector"))
    id_type = own.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            v = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            norm = np.sqrt(np.square(v).sum(axis=1))
            ok = np.isfinite(norm) & (norm > 0)
            v = v[ok] / norm[ok][:, None]
            if not len(v):
                continue
            angles = np.arccos(np.clip(v @ pivots.T, -1.0, 1.0))
            cell = angles.argmin(axis=1)
            bins = np.minimum(BINS - 1, angles[np.arange(len(v)), cell] / np.pi * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(ok)), pa.array(list(v), pa.list_(pa.float64())), pa.array(cell.astype(np.int32)), pa.array(bins)], names=["id", "vector", "cell", "bin"])

    return own.mapInArrow(run, f"id {id_type}, vector array<double>, cell int, bin int")


def in_blocks(cells: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(block, lo, hi, ids, vectors): ``cells`` as a row for each block, with the least and largest angles to all pivots.

    A block has vectors of a cell at like angles from its pivot, about BLOCK of them; a bin of more is dealt by a hash of the id.
    """
    counts = {(r["cell"], r["bin"]): r["n"] for r in cells.groupBy("cell", "bin").agg(F.count("*").alias("n")).toLocalIterator()}  # pivots times bins at most
    rows, block, held, last = [], -1, BLOCK, None
    for (cell, at), n in sorted(counts.items()):
        if cell != last or held + n > BLOCK:
            block, held, last = block + 1, 0, cell
        rows.append((cell, at, block, parts := max(1, -(-n // BLOCK))))
        block, held = block + parts - 1, held + n
    dealt = cells.sparkSession.createDataFrame(rows, "cell int, bin int, first int, parts int")
    own = cells.join(F.broadcast(dealt), ["cell", "bin"]).select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).alias("block"), "id", "vector")
    id_type = own.schema["id"].dataType.simpleString()

    def pack(rows: pa.Table) -> pa.Table:
        v = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        angles = np.arccos(np.clip(v @ pivots.T, -1.0, 1.0))
        ids = rows["id"].combine_chunks()
        row = {"block": rows["block"].slice(0, 1), "lo": [angles.min(axis=0).tolist()], "hi": [angles.max(axis=0).tolist()]}
        return pa.table(row | {"ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "vectors": [v.tobytes()]})

    return own.groupBy("block").applyInArrow(pack, f"block int, lo array<double>, hi array<double>, ids array<{id_type}>, vectors binary")


def met(blocks: DataFrame, threshold: float, columns: Sequence[str] = ()) -> DataFrame:
    """(x, y, and ``columns`` of either): the pairs of blocks, x <= y, that may hold vectors of cosine ``threshold`` or more.

    Angles obey the triangle inequality: if all of one block lies so far from a pivot and all of the other so near that the
    difference exceeds the angle of the threshold, no pair of theirs is near enough.  A task reads a part of the blocks and
    another part of them, so no block is sent or written for the sake of a pair.
    """
    far = float(np.arccos(np.clip(threshold, -1.0, 1.0))) + 1e-7
    side = lambda s: blocks.select(F.col("block").alias(s), F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi"), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    apart = lambda a, b: F.array_max(F.zip_with(f"{a}_lo", f"{b}_hi", lambda p, q: p - q)) > far
    near = (F.col("x") <= F.col("y")) & ~apart("x", "y") & ~apart("y", "x")
    return side("x").hint("shuffle_replicate_nl").join(side("y"), near).select("x", "y", *[f"{s}_{c}" for s in "xy" for c in columns])


def packed_blocks(embeddings: DataFrame) -> DataFrame | None:
    """The blocks of ``embeddings`` in a few parts of bounded size, as they were written; None if there are no vectors."""
    spark = embeddings.sparkSession
    dim, n = commonest_length(embeddings)
    pivots = chosen_pivots(embeddings.where(F.size("vector") == dim), min(PIVOTS, 1 + int(np.sqrt(n / BLOCK)))) if dim else np.empty((0, 0))
    if not len(pivots):
        return None
    blocks = saved(in_blocks(in_cells(embeddings, dim, pivots), pivots), "blocks")
    parts = max(-(-n * dim * 8 // PART), min(spark.sparkContext.defaultParallelism, -(-n // BLOCK)))
    return blocks.coalesce(parts)


def alike(batch: pa.RecordBatch, threshold: float) -> Iterator[tuple[int, int, pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """For each pair of blocks: its numbers and ids, the places of the vectors that are as near as ``threshold``, and their similarities."""
    for r in range(len(batch)):
        x, y = batch["x"][r].as_py(), batch["y"][r].as_py()
        one, other = batch["x_ids"][r].values, batch["y_ids"][r].values
        left, right = (np.frombuffer(batch[c][r].as_buffer(), np.float64).reshape(len(i), -1) for c, i in (("x_vectors", one), ("y_vectors", other)))
        s = left @ right.T
        i, j = np.nonzero(s >= threshold - 1e-9)
        s = s[i, j]
        near = s >= threshold
        yield x, y, one, other, i[near], j[near], s[near]


def similar_pairs(embeddings: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of all pairs with cosine at or above ``threshold``; a < b.

    Exact.  Vectors lie in blocks by their angles to a few pivots; pairs of blocks that can't reach the threshold are left out, and each
    of the others is compared by one matrix product.  The work grows with the square of the vectors, what is written doesn't.  Only vectors of
    the commonest length count; zero vectors never match.  ``compared_blocks`` tells how many pairs of blocks are left.
    """
    kind = embeddings.schema["id"].dataType.simpleString()
    schema = f"a {kind}, b {kind}, similarity double"
    blocks = packed_blocks(embeddings)
    if blocks is None:
        return embeddings.sparkSession.createDataFrame([], schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, one, other, i, j, s in alike(batch, threshold):
                a, b = one.take(pa.array(i)), other.take(pa.array(j))
                first = pc.less(a, b)
                if x == y:
                    yield pa.RecordBatch.from_arrays([a.filter(first), b.filter(first), pa.array(s).filter(first)], names=["a", "b", "similarity"])
                else:
                    yield pa.RecordBatch.from_arrays([pc.if_else(first, a, b), pc.if_else(first, b, a), pa.array(s)], names=["a", "b", "similarity"])

    return met(blocks, threshold, ("ids", "vectors")).mapInArrow(compare, schema)


def similar_links(embeddings: DataFrame, threshold: float) -> DataFrame:
    """(a, b): enough links between similar vectors to connect all that ``similar_pairs`` connects.

    A task links what its pairs connect to one of each set, so its rows are as many as its vectors at most, not as its pairs.
    """
    kind = embeddings.schema["id"].dataType.simpleString()
    blocks = packed_blocks(embeddings)
    if blocks is None:
        return embeddings.sparkSession.createDataFrame([], f"a {kind}, b {kind}")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        begin: dict[int, int] = {}
        parent = np.empty(0, np.int64)

        def place(block: int, ids: pa.Array) -> int:
            nonlocal parent
            if block not in begin:
                begin[block] = len(parent)
                parent = np.append(parent, np.arange(len(parent), len(parent) + len(ids)))
                held.append(pa.concat_arrays([ids]))
            return begin[block]

        def root(at: np.ndarray) -> np.ndarray:
            while len(at) and (parent[at] != at).any():
                at = parent[at]
            return at

        for batch in batches:
            for x, y, one, other, i, j, _ in alike(batch, threshold):
                a, b = place(x, one) + i, place(y, other) + j
                while True:
                    a, b = root(a), root(b)
                    open_ = a != b
                    if not open_.any():
                        break
                    a, b = np.minimum(a, b)[open_], np.maximum(a, b)[open_]
                    parent[b] = a  # of several the last; the others are open still
                if len(i):
                    parent[:] = parent[parent]
        if not held:
            return
        top = root(np.arange(len(parent)))
        moved = np.flatnonzero(top != np.arange(len(parent)))
        ids = pa.concat_arrays(held)
        for at in np.array_split(moved, 1 + len(moved) // 100_000):
            a, b = ids.take(pa.array(at)), ids.take(pa.array(top[at]))
            other = pc.not_equal(a, b)
            yield pa.RecordBatch.from_arrays([a.filter(other), b.filter(other)], names=["a", "b"])

    return met(blocks, threshold, ("ids", "vectors")).mapInArrow(link, f"a {kind}, b {kind}")


def compared_blocks(embeddings: DataFrame, threshold: float) -> tuple[int, int]:
    """How many pairs of blocks are compared, and how many there are."""
    blocks = packed_blocks(embeddings)
    if blocks is None:
        return 0, 0
    n = blocks.count()
    return met(blocks, threshold).count(), n * (n + 1) // 2


def connected(edges: DataFrame, checkpoint: str) -> DataFrame:
    """(id, cluster): the smallest id each node can reach over ``edges`` (a, b).

    Every round a node takes the smallest label among its own and its neighbours', then the label of
    that label; rounds are written below ``checkpoint`` so that lineage stays short.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both.write.mode("overwrite").parquet(f"{checkpoint}/edges")
    both = spark.read.schema(both.schema).parquet(f"{checkpoint}/edges")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("cluster"))
    number = 0
    while True:
        labels.write.mode("overwrite").parquet(f"{checkpoint}/labels-{number}")
        labels = spark.read.schema(labels.schema).parquet(f"{checkpoint}/labels-{number}")
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("cluster").alias("near"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", "cluster", F.least("cluster", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("cluster").alias("jump"))
        moved = step.join(jump, "next", "left").select("id", "cluster", F.least("next", F.coalesce("jump", "next")).alias("new"))
        moved.write.mode("overwrite").parquet(f"{checkpoint}/moved-{number}")
        moved = spark.read.schema(moved.schema).parquet(f"{checkpoint}/moved-{number}")
        labels = moved.select("id", F.col("new").alias("cluster"))
        if moved.where("new <> cluster").isEmpty():
            return labels
        number += 1


def duplicate_clusters(pairs: DataFrame, checkpoint: str, limit: int | None = S.CLUSTER_LIMIT) -> DataFrame:
    """(cluster, members, peak): clusters over similar pairs, highest peak similarity first."""
    labels = connected(pairs, checkpoint)
    peak = pairs.join(labels, pairs["a"] == labels["id"]).groupBy("cluster").agg(F.round(F.max("similarity"), 3).alias("peak"))
    members = labels.groupBy("cluster").agg(F.sort_array(F.collect_list("id")).alias("members"))
    out = members.join(peak, "cluster").select("cluster", "members", "peak")
    return out if limit is None else out.orderBy(F.desc("peak"), "cluster").limit(limit)


def title_clusters(memories: DataFrame) -> DataFrame:
    """Memories of one namespace with one title."""
    return memories.groupBy("namespace", "title").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids")).where("n > 1")


def clusters_or_titles(memories: DataFrame, embeddings: DataFrame, checkpoint: str, threshold: float = S.CLUSTER_SIMILARITY) -> tuple[str, DataFrame]:
    """Near-duplicate clusters of the embedded memories; those of equal titles where no memory is embedded, or none are alike and some aren't embedded."""
    own = embeddings.join(memories.select("id"), "id", "left_semi")
    pairs = similar_pairs(own, threshold)
    if own.isEmpty() or pairs.isEmpty() and not memories.join(own.select("id"), "id", "left_anti").isEmpty():
        return "titles", title_clusters(memories)
    return "vectors", duplicate_clusters(pairs, checkpoint)


def for_consolidation(memories: DataFrame, ids: list, strategy: str) -> DataFrame:
    """The memories to consolidate: at least two known ids of one namespace, and a known strategy."""
    wanted = list(dict.fromkeys(ids))
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    if len(wanted) < 2:
        raise ValueError("at least two memories are needed")
    found = memories.where(F.col("id").isin(wanted))
    held = found.agg(F.collect_set("id").alias("ids"), F.count_distinct("namespace").alias("namespaces")).first()  # no more than were asked for
    if missing := [i for i in wanted if i not in held["ids"]]:
        raise ValueError(f"unknown memories: {missing}")
    if held["namespaces"] > 1:
        raise ValueError("the memories are of several namespaces")
    return found


def similar_to(memories: DataFrame, embeddings: DataFrame | None, text: str, vector: list[float] | None, gate: tuple[float, float] = (S.DEDUPE_COSINE, S.DEDUPE_JACCARD), limit: int = 3) -> DataFrame:
    """Candidates past a gate, most similar first: by cosine where the query has a vector, else by word overlap."""
    if vector is not None and embeddings is not None:
        q = F.array(*[F.lit(float(x)) for x in vector])
        scored = memories.join(embeddings.where(F.size("vector") == len(vector)), "id").withColumn("similarity", cosine(F.col("vector"), q)).drop("vector")
        least = gate[0]
    else:
        scored = memories.withColumn("similarity", jaccard(tokens(F.concat_ws(" ", "title", "content")), tokens(F.lit(text))))
        least = gate[1]
    return scored.where(F.col("similarity") >= least).withColumn("similarity", F.round("similarity", 4)).orderBy(F.desc("similarity"), "id").limit(limit)


def consolidated(memories: DataFrame, cluster: Column | str, strategy: str = "merge") -> DataFrame:
    """One memory for each cluster.

    merge: all contents under their titles; summarize: a line for each; deduplicate: the best memory itself, by
    confidence, then update.  Type is the commonest (ties: first seen), confidence the highest, tags the union.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    df = memories.withColumn("cluster", F.col(cluster) if isinstance(cluster, str) else cluster)
    df = df.withColumn("_rank", confidence_rank())
    tag_union = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "tags"))), lambda x: x["tags"])))
    rows = F.array_sort(F.collect_list(F.struct("id", "title", "content", "type", "confidence", "_rank", "updated_at")))
    top = F.max(F.struct("_rank", "updated_at"))  # of its rows the one with the smallest id, whatever the type of ids
    grouped = df.groupBy("cluster").agg(F.count("*").alias("n"), top.alias("top"), tag_union.alias("tags"), rows.alias("rows"))
    at_top = F.filter("rows", lambda r: (r["_rank"] == F.col("top._rank")) & r["updated_at"].eqNullSafe(F.col("top.updated_at")))
    grouped = grouped.withColumn("best", F.get(at_top, F.lit(0)))
    kinds = df.groupBy("cluster", "type").agg(F.count("*").alias("k"), F.min("id").alias("first"))
    kind = kinds.groupBy("cluster").agg(F.min_by("type", F.struct((-F.col("k")).alias("minus"), "first")).alias("kind"))
    grouped = grouped.where("n > 1").join(kind, "cluster")
    if strategy == "deduplicate":
        return grouped.select("cluster", "n", F.col("best.id").alias("kept"), F.col("best.title").alias("title"), F.col("best.content").alias("content"), F.col("best.type").alias("type"), F.col("best.confidence").alias("confidence"), "tags")
    top = F.array_max(F.transform("rows", lambda r: F.struct(r["_rank"].alias("r"), r["confidence"].alias("c"))))["c"]
    if strategy == "merge":
        content = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("## "), r["title"], F.lit("\n"), r["content"])), "\n\n")
        title = F.concat(F.lit("[merge] "), F.col("rows")[0]["title"])
    else:
        line = lambda r: F.concat(F.lit("- "), r["title"], F.lit(": "), F.replace(F.substring(r["content"], 1, 160), F.lit("\n"), F.lit(" ")), F.when(F.length(r["content"]) > 160, "…").otherwise(""))
        content = F.concat(F.lit("Summary of "), F.col("n").cast("string"), F.lit(" memories:\n"), F.array_join(F.transform("rows", line), "\n"))
        title = F.concat(F.lit("[summarize] "), F.col("rows")[0]["title"])
    return grouped.select("cluster", "n", title.alias("title"), content.alias("content"), F.col("kind").alias("type"), top.alias("confidence"), "tags")


def retired(members: DataFrame, cluster: str = "cluster", kept: str = "kept") -> DataFrame:
    """Supersedes edges from what was kept to what it replaces."""
    return members.where(F.col("id") != F.col(kept)).select(F.col(kept).alias("source_id"), F.col("id").alias("target_id"), F.lit("supersedes").alias("relation_type"))
