"""Near-duplicate classes by BagMinHash.

A document is the bag (multiset) of its five-word shingles.  BagMinHash gives each
shingle of multiplicity w the points of a Poisson process up to weight w; the
signature holds, for every component, the earliest point of the whole bag, so two
signatures agree in a component with probability equal to the weighted Jaccard
similarity.  The process is hierarchical over the discretised weights: each dyadic
interval (0,1], (1,2], (2,4] ... has its own process, whose points are kept if their
weight coordinate lies below w, and generation stops at the signature's largest
value, so a shingle costs little more than its first point.

Signatures are cut into bands; documents that share a band are candidates and
are verified on the exact overlap of their bags.  Within a band's bucket pivots meet
the rest, a bounded number each round.  Comparisons are left out only where they
can't succeed or don't matter: the sizes of two bags, the elements of theirs that
documents of other classes may hold, and the overlap of their hashed counts limit their similarity; two documents that verified
links join already are in one class.  No bucket is capped and no link is given up.

Classes are the connected components of the verified links, with exact copies
(the same words in the same order) attached through one representative.

Defined results: the class is named by its smallest doc_id.  A null or wordless text links
to nothing and is a class of its own; a text of one to four words is one shingle.
Rows with one doc_id count as one document (any link of theirs joins it).  A row with
a null doc_id gets a null class.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.buckets import dealt, first_rows, to_bucket
from lorekeep.llm.common import saved, small, table

WORD = re.compile(r"\w+")
SHINGLE = 5
THRESHOLD = 0.8
#: 20 bands of 5 components: a pair at 0.8 shares no band with probability 4e-4.
BANDS, ROWS = 20, 5
#: Documents of a bucket that meet the rest of it in one round.
ROUND = 64
#: Cells of a profile, which counts a bag's elements by hash.
PROFILE = 128
#: Shingles whose points are drawn together.
BLOCK = 300_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x + _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingle_hashes(words: list[str]) -> np.ndarray:
    """A hash for each run of five words, in order; one for a shorter text."""
    if not words:
        return np.empty(0, np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    k = min(SHINGLE, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * _BASE + mix64(h[j : len(h) - k + 1 + j])
    return mix64(out)


def tagged_bag(words: list[str]) -> np.ndarray:
    """The bag as a set: the k-th occurrence of a shingle becomes an element of its own.

    Overlap and union of two such sets are the sums of minima and maxima of the multiplicities.
    """
    value, count = np.unique(shingle_hashes(words), return_counts=True)
    if len(value) and count.max() > 1:
        first = np.repeat(np.cumsum(count) - count, count)
        occurrence = (np.arange(count.sum()) - first).astype(np.uint64)
        value = np.repeat(value, count)
        with np.errstate(over="ignore"):
            value = np.where(occurrence > 0, mix64(value ^ mix64(occurrence)), value)
    return value.view(np.int64)


def bag_minhash(shingle: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, size: int) -> np.ndarray:
    """Signatures (docs x size) of bags given as (shingle, weight, doc) triples; inf for an empty bag."""
    seed, rate, keep, owner = [], [], [], []
    low, high = 0, 1
    while True:  # a process for each dyadic weight interval that a shingle reaches into
        some = weight > low
        if not some.any():
            break
        with np.errstate(over="ignore"):
            seed.append(mix64(shingle[some] ^ mix64(np.array([high], np.uint64))))
        rate.append(np.full(int(some.sum()), float(size * (high - low))))
        keep.append(np.minimum(1.0, (weight[some] - low) / (high - low)))
        owner.append(doc[some])
        low, high = high, high * 2
    out = np.full(docs * size, np.inf)
    if not seed:
        return out.reshape(docs, size)
    seed, rate, keep, owner = map(np.concatenate, (seed, rate, keep, owner))
    total = np.bincount(doc, weights=weight, minlength=docs)
    limit = (np.log(size) + 3.0) / np.maximum(total, 1.0)
    todo = np.arange(len(seed))
    while len(todo):
        _draw(out, seed[todo], rate[todo], keep[todo], owner[todo], limit, size)
        unfilled = (total > 0) & np.isinf(out.reshape(docs, size)).any(axis=1)
        limit = np.where(unfilled, limit * 2, limit)
        todo = np.flatnonzero(unfilled[owner])
    return out.reshape(docs, size)


def _draw(out: np.ndarray, seed: np.ndarray, rate: np.ndarray, keep: np.ndarray, owner: np.ndarray, limit: np.ndarray, size: int) -> None:
    """Put every point up to its document's limit into ``out``."""
    time, step = np.zeros(len(seed)), 0
    while len(seed):
        n = int(min(64, max(1, 100_000 // len(seed))))
        with np.errstate(over="ignore"):
            r = mix64(seed[:, None] ^ (np.arange(step + 1, step + n + 1, dtype=np.uint64) * _GOLDEN)[None, :])
        gap = -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / rate[:, None]
        at = time[:, None] + np.cumsum(gap, axis=1)
        row, col = np.nonzero(at <= limit[owner][:, None])
        h = mix64(r[row, col])
        inside = ((h >> np.uint64(32)).astype(np.float64) / 2.0**32) < keep[row]
        row, col, h = row[inside], col[inside], h[inside]
        component = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
        np.minimum.at(out, owner[row] * size + component, at[row, col])
        time, step = at[:, -1], step + n
        going = time <= limit[owner]
        seed, rate, keep, owner, time = seed[going], rate[going], keep[going], owner[going], time[going]


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = mix64(np.arange(BANDS, dtype=np.uint64))[None, :].repeat(len(signature), axis=0)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            key = mix64(key * _BASE + bits[:, :, j])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, digest, n, bands); bands are null for a wordless text."""
    for batch in batches:
        texts, at = batch.column("text"), 0
        while at < len(texts):
            bags, digests, begin, held = [], [], at, 0
            while at < len(texts) and held < BLOCK:
                words = words_of(texts[at].as_py())
                digests.append(hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest())
                bags.append(np.unique(shingle_hashes(words), return_counts=True))
                held += len(words)
                at += 1
            doc = np.repeat(np.arange(len(bags)), [len(v) for v, _ in bags])
            weight = np.concatenate([c for _, c in bags]).astype(np.float64)
            signature = bag_minhash(np.concatenate([v for v, _ in bags]), weight, doc, len(bags), BANDS * ROWS)
            bands = band_hashes(signature)
            n = [int(c.sum()) for _, c in bags]
            columns = [
                batch.column("doc_id").slice(begin, at - begin),
                pa.array(digests, pa.binary()),
                pa.array(n, pa.int32()),
                pa.array([b if k else None for b, k in zip(bands, n, strict=True)], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n", "bands"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        while at < len(batch):
            bags, begin, held = [], at, 0
            while at < len(batch) and held < BLOCK:
                bags.append(tagged_bag(words_of(batch.column("text")[at].as_py())))
                held += len(bags[-1])
                at += 1
            profiles = [np.bincount(b.view(np.uint64) % np.uint64(PROFILE), minlength=PROFILE).astype(np.int32) for b in bags]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, at - begin), pa.array(bags, pa.list_(pa.int64())), pa.array(profiles, pa.list_(pa.int32()))], names=["doc_id", "bag", "profile"])


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two tagged bags."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return both / (F.size(a) + F.size(b) - both)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): contraction to hashed minima.

    Each round every node joins the neighbour (or itself) that comes first in a
    hashed order, so chains shrink by a constant factor and stars end in two rounds; the edges
    between the joined nodes go on.  Minima are partly aggregated, so a hub is no hot task.
    """
    roots = None
    edges = saved(edges.where("a <> b").select("a", "b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        place = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("id"))
        joined = both.groupBy(F.col("a").alias("node")).agg(F.min(place(F.col("b"))).alias("first"))
        own = place(F.col("node"))
        joined = saved(joined.select("node", F.when(own < F.col("first"), F.col("node")).otherwise(F.col("first.id")).alias("to")), "joined")
        if roots is None:
            roots = joined.select("node", F.col("to").alias("root"))
        else:
            step = joined.withColumnsRenamed({"node": "_n", "to": "_to"})
            roots = saved(roots.join(step, roots["root"] == step["_n"], "left").select("node", F.coalesce("_to", "root").alias("root")), "roots")
        left, right = joined.withColumnsRenamed({"node": "a", "to": "a2"}), joined.withColumnsRenamed({"node": "b", "to": "b2"})
        edges = saved(edges.join(left, "a").join(right, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a <> b").distinct(), "edges")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def unshared(bags: DataFrame, classes: DataFrame | None) -> DataFrame:
    """(doc, alone): how many elements of a document's bag are sure to be held by its own class only.

    Those with up to three holders, all of one class, are counted; the holders follow from the
    smallest, the largest and the sum of their ids, so elements needn't be joined back to documents.
    """
    held = bags.select(F.col("doc_id").alias("doc"), "bag")
    held = held.withColumn("class", F.col("doc")) if classes is None else held.join(classes, "doc", "left").withColumn("class", F.coalesce("class", "doc"))
    held = held.select("doc", "class", F.explode("bag").alias("element"))
    by = held.groupBy("element").agg(F.min("class").alias("one"), F.max("class").alias("other"), F.count("*").alias("k"), F.min("doc").alias("low"), F.max("doc").alias("high"), F.sum(F.col("doc").cast("decimal(38,0)")).alias("sum"))
    few = by.where("one = other AND k <= 3")
    third = (F.col("sum") - F.col("low") - F.col("high")).cast("long")
    docs = F.when(F.col("k") == 1, F.array("low")).when(F.col("k") == 2, F.array_distinct(F.array("low", "high"))).otherwise(F.array_distinct(F.array("low", third, "high")))
    return few.select(F.explode(docs).alias("doc")).groupBy("doc").agg(F.count("*").alias("alone"))


def ceiling(n: str, s: str, n2: str, s2: str, overlap: Column | None = None) -> Column:
    """The largest similarity that two bags with so many elements and shared elements can have."""
    common = (F.least(s, s2) if overlap is None else F.least(s, s2, overlap)).cast("double")
    alone = F.col(n) - F.col(s) + F.col(n2) - F.col(s2)
    return common / F.greatest(F.col(n) + F.col(n2) - common, common + alone)


def linked_classes(rows: DataFrame, sizes: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """(doc, class) for all with a verified link in the buckets of ``rows`` (bucket, doc, n, k, salt) and ``sizes``, as ``dealt`` gives them.

    Every round, pivots of a bucket meet the rest of it that is in another class so far, and leave
    the bucket.  The first round is for buckets of up to ``ROUND`` documents, all of them pivots.  Larger ones
    start with one pivot, the document with the largest shared part, and go on with up
    to ``ROUND`` of those outside the bucket's largest class.  Rows that can't link to another class go, as do
    buckets with one class, until none is left.  Large buckets are dealt over several tasks; their pivots and facts are sent to each.
    """
    rest, rows, every = rows.where(F.col("k") > ROUND).drop("k"), rows.where(F.col("k") <= ROUND).drop("k"), bags
    found, classes, number = None, None, 0
    while True:
        if number == 0:
            facts = unshared(bags, classes).withColumn("profile", F.lit(None).cast("array<int>"))
        elif number == 1:  # in large buckets a profile's overlap limits a pair's, too; later counts could only be larger
            facts = saved(bags.select(F.col("doc_id").alias("doc"), "profile").join(unshared(bags, classes), "doc", "left"), "facts")
        if classes is not None:
            rows = rows.join(classes, "doc", "left").withColumn("class", F.coalesce("class", "doc"))
        else:
            rows = rows.withColumn("class", F.col("doc"))
        rows = rows.join(facts, "doc", "left").withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0)))
        rows = rows.where(F.col("shared") >= threshold * F.col("n") - 1e-9).drop("alone")
        held = rows.groupBy("bucket", "class").agg(F.count("*").alias("k"), F.min("n").alias("least"), F.min(F.col("n") - F.col("shared")).alias("alone"))
        ends = held.groupBy("bucket").agg(F.count("*").alias("classes"), F.min("least").alias("least"), F.min("alone").alias("alone"), F.max(F.struct("k", (-F.col("class")).alias("minus"))).alias("main"))
        ends = ends.where("classes > 1").select("bucket", "least", "alone", (-F.col("main.minus")).alias("main"))
        rows = to_bucket(rows, ends, sizes)
        # the best that a partner of the bucket's least size and least unshared part would allow
        size = F.greatest("least", "shared") + F.col("n") - F.col("shared")
        part = F.col("n") + F.col("alone")
        rows = saved(rows.where(F.col("shared") / F.greatest(size, part) >= threshold - 1e-9).select("bucket", "salt", "doc", "n", "shared", "class", "main", "profile"), "open")
        if number == 1:
            best = rows.groupBy("bucket").agg(F.min(F.struct((-F.col("shared") / F.col("n")).alias("part"), "doc")).alias("p"))
            chosen = rows.join(best.select("bucket", F.col("p.doc").alias("doc")), ["bucket", "doc"])
        else:
            chosen = first_rows(rows.where("class <> main" if number else "true"), [(F.col("shared") / F.col("n")).desc(), F.col("doc")], ROUND)
        chosen = saved(chosen.select("bucket", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"), F.col("class").alias("ca"), F.col("profile").alias("pa")), "chosen")
        if number and chosen.isEmpty():
            return classes
        near = to_bucket(rows, chosen, sizes).where(F.col("class") != F.col("ca")).where(ceiling("n", "shared", "na", "sa") >= threshold - 1e-9)
        if number:
            overlap = F.aggregate(F.zip_with("profile", "pa", lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x)
            near = near.where(ceiling("n", "shared", "na", "sa", overlap) >= threshold - 1e-9)
        judged = _judge(near.select(F.least("a", "doc").alias("a"), F.greatest("a", "doc").alias("b")), bags)
        links = judged.where(F.col("d") <= 1.0 - threshold + 1e-12).select("a", "b")
        found = links if found is None else found.union(links)
        if classes is None or not links.isEmpty():
            classes = saved(components(found).withColumnsRenamed({"node": "doc", "root": "class"}), "classes")
        if number:
            rest = rows.join(chosen.select("bucket", F.col("a").alias("doc")), ["bucket", "doc"], "left_anti").select("bucket", "salt", "doc", "n")
        several = rest.join(classes, "doc", "left").groupBy("bucket").agg(F.min(F.coalesce("class", "doc")).alias("one"), F.max(F.coalesce("class", "doc")).alias("other")).where("one <> other").select("bucket")
        rows = saved(to_bucket(rest, several, sizes), "rest")
        bags = every.join(rows.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
        number += 1


def _judge(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """(a, b, d): the distance of each distinct pair."""
    side = lambda name: bags.select(F.col("doc_id").alias(name), F.col("bag").alias(f"bag_{name}"))
    left, right = side("a"), side("b")
    met = pairs.distinct().join(right, "b").join(left, "a")
    return saved(met.select("a", "b", (1.0 - similarity(F.col("bag_a"), F.col("bag_b"))).alias("d")), "judged")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row (doc_id, class_id) for each row of ``docs`` (doc_id, text)."""
    own = docs.select("doc_id", "text")
    signed = saved(own.mapInArrow(_sign, "doc_id long, digest binary, n int, bands array<long>"), "signed")
    copies = signed.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    copies = small(saved(copies.select("digest", "first"), "copies"))
    member = saved(
        signed.join(copies, "digest", "left").select("doc_id", F.coalesce("first", "doc_id").alias("rep"), "n", F.when(F.coalesce("first", "doc_id") == F.col("doc_id"), F.col("bands")).alias("bands")),
        "member",
    )
    reps = member.where("doc_id IS NOT NULL AND bands IS NOT NULL").select(F.col("doc_id").alias("doc"), "n", "bands")
    rows = reps.select(F.explode("bands").alias("bucket"), "doc", "n")
    shared = rows.groupBy("bucket").agg(F.min("doc").alias("one"), F.max("doc").alias("other"), F.count("*").alias("k")).where("one <> other")
    rows, sizes = dealt(rows.join(shared.select("bucket", "k"), "bucket"), "doc")
    wanted = rows.select(F.col("doc").alias("doc_id")).distinct().hint("merge")  # one plan at every size, so a small run shows the shuffle of a large one
    bags = own.join(wanted, "doc_id", "left_semi").mapInArrow(_bags, "doc_id long, bag array<long>, profile array<int>")
    classes = linked_classes(rows, sizes, saved(bags, "bags"), threshold)
    # an id whose rows have several texts ties their representatives together
    several = member.groupBy("doc_id").agg(F.min("rep").alias("one"), F.max("rep").alias("other")).where("one <> other").select("doc_id")
    ties = member.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = classes.withColumnsRenamed({"doc": "node", "class": "root"})
    ties = saved(ties, "ties")
    if not ties.isEmpty():
        roots = components(classes.select(F.col("doc").alias("a"), F.col("class").alias("b")).union(ties))
    names = roots.groupBy("root").agg(F.min("node").alias("class_id"))
    classes = roots.join(names, "root").select(F.col("node").alias("rep"), "class_id")
    done = member.join(classes, "rep", "left").select("doc_id", F.coalesce("class_id", "rep").alias("class_id"))
    return done.withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")))


def first_of_each_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without all but the first document of every class; rows with a null doc_id stay."""
    others = near_duplicates(docs, threshold).where("class_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def op2_near_dup(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
