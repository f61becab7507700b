"""Ranked lexical search by bit-sliced Bloom signatures, exact in its results.

The index: documents of like numbers of entries lie together in blocks.  A block is a matrix of bits, a column for each
document and about 16 rows for each entry; a document's entry sets its bit in ``HASHES`` of them.  An entry is a term
together with a step of its frequency (``STEPS``): a term that occurs 5 times has the entries for 1, 2, 3 and 5.  A row of the matrix is a slice
over all documents of the block, so the slices of a query's entry, joined by and, mark every document that holds it and a few that don't.

Search: a term's marks times its weight, summed over an item's terms for each step, times what the step adds at most to the score of a document of that length,
give an upper bound of the document's score.  The highest bounds of each item are rescored from the texts; the lowest of the best of
those scores is a threshold, and then every document whose bound reaches it is rescored.  What isn't was provably excluded.

Items are taken in blocks of bounded size; blocks of the index, the bounds and the rescoring are spread over tasks.

Defined results: terms are maximal runs of letters and digits of ASCII and of all other characters beyond it, A to Z in lower case; whole texts
are searched, null and empty ones have no terms.  Rows are documents: rows with one doc_id are ranked each, equal scores by ascending doc_id, nulls last,
then by the text's hash.  A null item text, one without known terms, and an empty table of documents find nothing; items with a null or repeated item_id are one each, so repeated ones have
ranks of their own.  Other columns of either side are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import saved, small, table
from lorekeep.llm.packed import mixed, portions

#: Slices for each entry, rows of the matrix for each entry of a document, and bits of a row.
HASHES, ROWS, WIDTH = 5, 16, 2048
#: Frequencies from which a term has a further entry; a step's bound is the frequency before the next one.
STEPS = (1, 2, 3, 5, 9)
#: Entries of the documents of a block, at most (one document may have more).
ENTRIES = 4_000_000
#: Bytes of items' texts that are searched at once.
ITEM_BYTES = 4_000_000
#: Documents of each item whose scores give the threshold.
PROBES = 60
#: Scores of documents without an upper bound are below this for each unit of weight.
MOST = 1_000_000
#: Item and term pairs times documents that a task sums at a time.
SUMMED = 20_000_000

# What separates terms, and lower case.
TO_TERMS = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TO_TERMS).split(b" ") if text else []


def found_terms(text: bytes) -> list[bytes]:
    return [t for t in terms(text) if t]


class Hashes(dict):
    """The hash of a term, remembered."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[term] = found = xxhash.xxh3_64_intdigest(term)
        return found


def slices(hashes: np.ndarray, step: np.ndarray | int, rows: int) -> np.ndarray:
    """The rows of each entry, (entries, HASHES)."""
    first = mixed(hashes + np.uint64(0x9E3779B97F4A7C15) * np.asarray(step, np.uint64))
    second = mixed(first) | np.uint64(1)
    return ((first[:, None] + second[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(rows)).astype(np.int64)


def matrix(held: list[tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
    """Packed bits (rows, bytes) of documents given as their terms' hashes and frequencies."""
    bits = np.zeros((rows, -(-len(held) // 8) * 8), np.uint8)
    for column, (hashes, tf) in enumerate(held):
        for step in STEPS:
            own = hashes[tf >= step]
            if not len(own):
                break
            bits[slices(own, step, rows).ravel(), column] = 1
    return np.packbits(bits, axis=1)


def write_index(docs: DataFrame, wanted: dict[bytes, int]) -> DataFrame:
    """The blocks of ``docs`` (doc_id, text), saved; and for the ``wanted`` terms the number of documents that hold them.

    Rows of kind 0 are blocks (ids, text hashes and lengths of their documents, number of slices, bits), those of kind 1 a task's numbers: documents
    with a term, terms with repeats, and of each wanted term its documents.
    """
    sent = docs.sparkSession.sparkContext.broadcast(wanted)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"kind int, ids array<{id_type}>, hashes array<long>, lengths array<long>, slices long, bits binary, documents long, terms long, df binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, known, open_blocks = sent.value, Hashes(), {}
        df, n_docs, n_terms, id_arrow = np.zeros(len(places), np.int64), 0, 0, None

        def block(size: int) -> pa.RecordBatch:
            ids, marks, lengths, held = zip(*open_blocks.pop(size)[0], strict=True)
            rows = ROWS << size
            values = [[0], [list(ids)], [list(marks)], [list(lengths)], [rows], [matrix(list(held), rows).tobytes()], [0], [0], [None]]
            types = [pa.int32(), pa.list_(id_arrow), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)

        for rows, texts in portions(batches):
            column = rows.column("doc_id")
            id_arrow = id_arrow or column.type
            for doc_id, mark, text in zip(column.to_pylist(), rows.column("mark").to_pylist(), texts, strict=True):
                counted = Counter(found_terms(text))
                if not counted:
                    continue
                n = counted.total()
                n_docs, n_terms = n_docs + 1, n_terms + n
                asked = [i for i in map(places.get, counted) if i is not None]
                df[asked] += 1
                hashes = np.fromiter(map(known.__getitem__, counted), np.uint64, len(counted))
                tf = np.fromiter(counted.values(), np.int64, len(counted))
                entries = sum(int(np.count_nonzero(tf >= s)) for s in STEPS)
                size = (entries - 1).bit_length()
                own = open_blocks.setdefault(size, ([], [0]))
                own[0].append((doc_id, mark, n, (hashes, tf)))
                own[1][0] += entries
                if len(own[0]) >= WIDTH or own[1][0] >= ENTRIES:
                    yield block(size)
        for size in sorted(open_blocks):
            yield block(size)
        if n_docs:
            values = [[1], [None], [None], [None], [0], [None], [n_docs], [n_terms], [df.tobytes()]]
            types = [pa.int32(), pa.list_(id_arrow), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)

    return saved(docs.mapInArrow(run, schema), "signatures")


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a unit of weight adds to a score."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def norm(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    return 75 + 25 * lengths * n // max(1, total)


class Questions:
    """Items as sorted lists of places in an array of distinct terms, with the terms' weights."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.places: dict[bytes, int] = {}
        self.items = []
        for number, text in items:
            counted = Counter(self.places.setdefault(t, len(self.places)) for t in found_terms(text))
            if counted:
                own = sorted(counted)
                self.items.append((number, np.array(own), np.array([counted[i] for i in own])))
        self.hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in self.places], np.uint64)
        self.weights = np.zeros(len(self.places), np.int64)
        self.n = self.total = 0

    def learn(self, n: int, total: int, df: np.ndarray) -> None:
        self.n, self.total = n, total
        # a term that no document holds adds nothing; one in all documents may weigh nothing
        self.weights = np.array([int(1000 * log((2 * n + 2) / (2 * d + 1)) // 1) if d else 0 for d in df.tolist()], np.int64)

    def bounds(self, rows: int, bits: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Of each item the upper bounds of the scores of a block's documents, in groups of items."""
        m, n_docs = norm(lengths, self.n, self.total), len(lengths)
        steps = [*STEPS[1:], None]
        most = [part(np.full(n_docs, s - 1), m) if s else np.full(n_docs, MOST) for s in steps]
        adds = [most[0], *(b - a for a, b in zip(most, most[1:], strict=False))]
        begin = 0
        while begin < len(self.items):
            end, held = begin, 0
            while end < len(self.items) and (end == begin or held + len(self.items[end][1]) <= SUMMED // max(n_docs, 1)):
                held += len(self.items[end][1])
                end += 1
            own = self.items[begin:end]
            used, back = np.unique(np.concatenate([x[1] for x in own]), return_inverse=True)
            weights = self.weights[used][back] * np.concatenate([x[2] for x in own])
            starts = np.cumsum([0, *(len(x[1]) for x in own)][:-1])
            bound = np.zeros((len(own), n_docs), np.int64)
            live = np.arange(len(used))
            marks = np.full((len(used), bits.shape[1]), 255, np.uint8)
            for step, add in zip(STEPS, adds, strict=True):
                at = slices(self.hashes[used[live]], step, rows)
                joined = bits[at[:, 0]]
                for i in range(1, HASHES):
                    joined &= bits[at[:, i]]
                marks[live] &= joined
                some = marks[live].any(axis=1)
                marks[live[~some]] = 0
                live = live[some]
                if not len(live):
                    break
                rows_of = np.unpackbits(marks, axis=1, count=n_docs)[back].astype(np.float64)  # whole numbers below 2**53
                bound += np.add.reduceat(rows_of * weights[:, None], starts, axis=0).astype(np.int64) * add
            for (number, _, _), x in zip(own, bound, strict=True):
                yield number, x
            begin = end

    def scores(self, text: bytes, numbers: list[int]) -> list[int]:
        """The exact scores of a whole text for some items."""
        counted, get = Counter(found_terms(text)), self.places.get
        m = 75 + 25 * counted.total() * self.n // max(1, self.total)
        of_term = {i: (1_000_000_000 * tf) // (1000 * tf + 12 * m) for t, tf in counted.items() if (i := get(t)) is not None}
        by_number = self.by_number
        return [sum(int(self.weights[i]) * c * of_term[i] for i, c in zip(*by_number[x], strict=True) if i in of_term) for x in numbers]

    @property
    def by_number(self) -> dict[int, tuple[list[int], list[int]]]:
        if not hasattr(self, "_by_number"):
            self._by_number = {n: (p.tolist(), c.tolist()) for n, p, c in self.items}
        return self._by_number


def candidates(index: DataFrame, sent, least: dict[int, int] | None, probes: int, id_type: str) -> DataFrame:
    """(number, doc_id, mark, bound): of each block the ``probes`` highest bounds of each item, or with ``least`` all that reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                lengths = np.array(batch.column("lengths")[row].as_py(), np.int64)
                ids, marks = batch.column("ids")[row].values, batch.column("hashes")[row].values
                rows = batch.column("slices")[row].as_py()
                bits = np.frombuffer(batch.column("bits")[row].as_py(), np.uint8).reshape(rows, -1)
                numbers, places, bounds = [], [], []
                for number, bound in asked.bounds(rows, bits, lengths):
                    if least is not None:
                        own = np.flatnonzero(bound >= max(1, least.get(number, 1)))
                    else:
                        own = np.argpartition(-bound, probes - 1)[:probes] if len(bound) > probes else np.arange(len(bound))
                        own = own[bound[own] > 0]
                    numbers.append(np.full(len(own), number, np.int64))
                    places.append(own)
                    bounds.append(bound[own])
                at = np.concatenate(places) if places else np.empty(0, np.int64)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(numbers)), ids.take(pa.array(at)), marks.take(pa.array(at)), pa.array(np.concatenate(bounds))], names=["number", "doc_id", "mark", "bound"]
                    )

    return index.mapInArrow(run, f"number long, doc_id {id_type}, mark long, bound long")


def rescored(docs: DataFrame, pairs: DataFrame, sent) -> DataFrame:
    """(number, doc_id, mark, score) of the candidates, from the whole texts."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    asked = saved(pairs.groupBy("doc_id", "mark").agg(F.collect_set("number").alias("numbers")).select(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark"), "numbers"), "candidates")
    # small() counts the rows; a row has as many numbers as a block of items, at most
    texts = docs.join(small(asked), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark"))).select("doc_id", "mark", "text", "numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for rows, texts in portions(batches):
            numbers = rows.column("numbers").to_pylist()
            scores = [own.scores(t, n) for t, n in zip(texts, numbers, strict=True)]
            at = pa.array(np.repeat(np.arange(len(numbers)), [len(n) for n in numbers]))
            flat = lambda x: pa.array([z for y in x for z in y], pa.int64())
            yield pa.RecordBatch.from_arrays([flat(numbers), rows.column("doc_id").take(at), rows.column("mark").take(at), flat(scores)], names=["number", "doc_id", "mark", "score"])

    return texts.mapInArrow(run, f"number long, doc_id {id_type}, mark long, score long").where("score > 0")


def best(scored: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each item, ranked."""
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "mark")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each item."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    items = saved(items.select("item_id", "text", F.monotonically_increasing_id().alias("number")), "items")
    held = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + held // ITEM_BYTES
    out = None
    for i in range(parts):
        own = items.where(F.pmod(F.xxhash64("number"), F.lit(parts)) == i)
        questions = Questions([(r["number"], (r["text"] or "").encode()) for r in own.select("number", "text").toLocalIterator()])
        made = write_index(docs, questions.places)
        n = total = 0
        df = np.zeros(len(questions.places), np.int64)
        for r in made.where("kind = 1").select("documents", "terms", "df").toLocalIterator():  # a row for each task
            n, total, df = n + r["documents"], total + r["terms"], df + np.frombuffer(r["df"], np.int64)
        questions.learn(n, total, df)
        index, sent, id_type = made.where("kind = 0"), spark.sparkContext.broadcast(questions), docs.schema["doc_id"].dataType.simpleString()
        place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("bound"), "doc_id", "mark"))
        probes = candidates(index, sent, None, PROBES, id_type).withColumn("place", place).where(F.col("place") <= PROBES)
        tried = saved(rescored(docs, probes, sent), "probes")
        tops = tried.withColumn("place", F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score")))).where(F.col("place") == k)
        least = {r["number"]: r["score"] for r in tops.select("number", "score").toLocalIterator()}  # one for each item of the block
        every = candidates(index, sent, least, PROBES, id_type)
        ranked = best(rescored(docs, every, sent), k).join(own.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.union(ranked)
    return out


def op13_lexical(spark, sf_dir: str) -> DataFrame:
    """Rank all ``documents`` for every ``benchmark`` item."""
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), c AS (
  SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), d AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM c GROUP BY doc_id
), s AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d
), q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) x GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM c GROUP BY term) x, s
), r AS (
  SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN c USING (term) JOIN d USING (doc_id), s GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 20
"""
