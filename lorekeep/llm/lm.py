"""Scoring by an interpolated modified Kneser-Ney bigram model in memory-mapped arrays.

The model is counted in Spark in three steps, each over all training texts or over what the last
one wrote: words, bigrams, and for each word its continuations (distinct words before it) and what
follows it.  A word is the 64-bit hash of its bytes; each shard of words is one
file in the shared folder with the sorted hashes and their counts, and a word's place among all of them
is its number.  A bigram is the two numbers in one 64-bit key, exact; its shards are files of
sorted keys and counts, too.  Workers map the files into memory and look up the sorted
words and bigrams of a portion of texts at a time, so a worker holds no model and the pages are shared.

Bigrams are dealt to shards by their first word; a frequent first word is dealt over as many as its count asks for,
which every worker knows from the words' files.  Files are written under another name and then
renamed, so a task that runs twice does no harm.  The driver gets one short row for each shard.

    p(w)     = (cont(w) - D(cont(w))) / T + g * 1 / (V + 1)         cont: distinct words before w, T: their sum
    p(w | h) = (c(hw) - D(c(hw))) / c(h) + g(h) * p(w)              or p(w), if nothing follows h in training

with discounts D for counts of 1, 2 and more, from the counts of counts of either order, and g whatever is left, so that
each sums to 1 over the V training tokens and one for all unknown words.

Defined results: texts are cut into words at ASCII white space, A to Z in lower case; each has one end token, so a null
or empty text has one token and a score.  Every row is scored for itself, repeated ids too; a null doc_id
counts as the empty string for the held-out rule.  Without training rows N and V are 0 and every token's
probability is 1.  Where a corpus is too small to have counts of counts, discounts
are half the count.  Other columns stay, but those that the result names are replaced.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import new_path, saved, table
from lorekeep.llm.packed import CHUNKS, chunks, mixed, portions, shard_bits, shard_of, summed

#: What stands before the first word and after the last: no word is empty or a space.
BEGIN, END = xxhash.xxh3_64_intdigest(b""), xxhash.xxh3_64_intdigest(b" ")
#: Words remembered by a worker.
REMEMBERED = 200_000
#: Tokens of a first word for each shard that its bigrams are dealt to.
HOT = 200_000
#: Bytes of text that a worker handles at a time.
AT_ONCE = 4_000_000
SUMMARY = "shard int, n long, tokens long, n1 long, n2 long, n3 long, n4 long"


def held_out(doc_id: Column) -> Column:
    """Rows that the model doesn't learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


class Hashes(dict):
    """The hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def tokens(texts: list[bytes], known: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens with BEGIN before each text, and the place of each BEGIN."""
    arrays, starts, at = [], [], 0
    for text in texts:
        words = text.lower().split()
        x = np.empty(len(words) + 2, np.uint64)
        x[0], x[-1] = BEGIN, END
        x[1:-1] = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        arrays.append(x)
        starts.append(at)
        at += len(x)
    return np.concatenate(arrays), np.array(starts)


def local_folder(path: str) -> str:
    """The folder in which tasks write and map files: the shared one must be mounted on every machine."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"the model's files are mapped into memory, so spark.checkpoint.dir must be a mounted folder, not {path}")
    return unquote(parts.path)


def put(folder: str, name: str, keys: np.ndarray, *values: np.ndarray) -> None:
    """Write arrays of equal length behind a header, all at once or not at all."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}"
    with open(f"{path}.{os.getpid()}-{os.urandom(4).hex()}", "wb") as f:
        np.array([len(keys), *(v.itemsize for v in values)], "<u8").tofile(f)
        for x in (keys, *values):
            x.tofile(f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


@lru_cache(maxsize=4096)
def mapped(path: str, *kinds: str) -> tuple[np.ndarray, ...]:
    """The keys and values of a file that ``put`` wrote; nothing if there is none."""
    if not os.path.exists(path):
        return (np.empty(0, np.uint64), *(np.empty(0, k) for k in kinds))
    raw = np.memmap(path, np.uint8, "r")
    head = raw[: 8 * (1 + len(kinds))].view("<u8")
    n, at, out = int(head[0]), 8 * (1 + len(kinds)), []
    for kind, width in zip(("<u8", *kinds), (8, *head[1:].tolist()), strict=True):
        out.append(raw[at : at + n * width].view(kind if kind != "count" else f"<u{width}"))
        at += n * width
    return tuple(out)


def counts_of_counts(c: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(c == k)) for k in (1, 2, 3, 4)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken from counts of 1, 2 and more."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    return tuple(min(float(k), max(0.1, k - (k + 1) * y * b / a)) if a and y else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)], 0.0)


@dataclass
class Model:
    """Where the arrays lie and the few numbers that hold for all of them."""

    folder: str
    bits: int
    offsets: np.ndarray | None = None  # the first number of each shard of words
    n: int = 0
    v: int = 0
    bigram_d: tuple[float, float, float] = (0.0, 0.0, 0.0)
    word_d: tuple[float, float, float] = (0.0, 0.0, 0.0)
    total: int = 0  # of continuations
    rest: float = 0.0  # what the discounts leave to the uniform part

    def words(self, hashes: np.ndarray, followed: bool = False) -> dict[str, np.ndarray]:
        """Of sorted hashes: number (-1: unknown) and count; with ``followed`` also what stands before and behind."""
        out = {"number": np.full(len(hashes), -1, np.int64), "count": np.zeros(len(hashes), np.int64)}
        if followed:
            out |= {"before": np.zeros(len(hashes), np.int64), "behind": np.zeros(len(hashes), np.int64), "gamma": np.zeros(len(hashes))}
        for shard, a, b in runs(shard_of(hashes, self.bits)):
            keys, counts = mapped(f"{self.folder}/words-{shard}", "<u8")
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, hashes[a:b]), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == hashes[a:b])
            at = at[hit]
            out["number"][a + hit] = self.offsets[shard] + at
            out["count"][a + hit] = counts[at]
            if followed:
                _, *more = mapped(f"{self.folder}/followed-{shard}", "<u8", "<u8", "<f8")
                for name, x in zip(("before", "behind", "gamma"), more, strict=True):
                    out[name][a + hit] = x[at]
        return out

    def bigram_shards(self, first: np.ndarray, second: np.ndarray, first_count: np.ndarray) -> np.ndarray:
        salts = 1 + first_count.astype(np.uint64) // np.uint64(HOT)
        return shard_of(mixed(first.astype(np.uint64) ^ (mixed(second) % salts << np.uint64(32))), self.bits)

    def bigrams(self, first: np.ndarray, second: np.ndarray, first_count: np.ndarray) -> np.ndarray:
        """The counts of pairs of numbers."""
        out, keys = np.zeros(len(first), np.int64), first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
        shards = self.bigram_shards(first, second, first_count)
        order = np.lexsort((keys, shards))
        for shard, a, b in runs(shards[order]):
            held, counts = mapped(f"{self.folder}/bigrams-{shard}", "count")
            if len(held):
                own = order[a:b]
                at = np.minimum(np.searchsorted(held, keys[own]), len(held) - 1)
                out[own] = np.where(held[at] == keys[own], counts[at], 0)
        return out


def runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of the runs of equal values."""
    if not len(values):
        return
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    for a, b in zip(starts, [*starts[1:], len(values)], strict=True):
        yield int(values[a]), int(a), int(b)


def pairs(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes and the inverse; of the distinct bigrams the first and second as places in them, and the inverse."""
    distinct, inverse = np.unique(hashes, return_inverse=True)
    inside = np.ones(len(hashes) - 1, bool)
    inside[starts[1:] - 1] = False
    joint = (inverse[:-1].astype(np.int64) * len(distinct) + inverse[1:])[inside]
    both, back = np.unique(joint, return_inverse=True)
    return distinct, inverse, both // len(distinct), both % len(distinct), back


def _summary(shard: int, n: int, total: int, c: np.ndarray) -> pa.Table:
    values = [shard, n, total, *counts_of_counts(c)]
    return pa.table({name.split()[0]: pa.array([x], pa.int32() if i == 0 else pa.int64()) for i, (name, x) in enumerate(zip(SUMMARY.split(", "), values, strict=True))})


def _totals(spark: SparkSession, summary: DataFrame) -> dict[str, int]:
    return {k: v or 0 for k, v in summary.agg(*[F.sum(c).alias(c) for c in ("n", "tokens", "n1", "n2", "n3", "n4")]).first().asDict().items()}


def train(texts: DataFrame) -> Model:
    """Count the model of ``texts`` (text) into the shared folder."""
    spark = texts.sparkSession
    model = Model(local_folder(new_path(spark, "lm")), shard_bits(texts))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for _, own in portions(batches, most=AT_ONCE):
            distinct, n = np.unique(tokens(own, known)[0], return_counts=True)
            yield from chunks(shard_of(distinct, model.bits), distinct, n)

    def words_file(rows: pa.Table) -> pa.Table:
        keys, (n,) = summed(rows)
        shard = rows.column("shard")[0].as_py()
        put(model.folder, f"words-{shard}", keys.astype("<u8"), n.astype("<u8"))
        real = n[keys != np.uint64(BEGIN)]  # what stands before the texts is no token
        return _summary(shard, len(keys), int(real.sum()), np.empty(0))

    found = saved(texts.select("text").mapInArrow(words, CHUNKS).groupBy("shard").applyInArrow(words_file, SUMMARY), "lm-words")
    lengths = np.zeros(1 << model.bits, np.int64)
    for row in found.select("shard", "n").toLocalIterator():
        lengths[row["shard"]] = row["n"]
    model.offsets = np.concatenate([[0], np.cumsum(lengths)])
    model.n, model.v = _totals(spark, found)["tokens"], max(0, int(model.offsets[-1]) - 1)

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for _, own in portions(batches, most=AT_ONCE):
            distinct, _, first, second, back = pairs(*tokens(own, known))
            held = model.words(distinct)
            a, b = held["number"][first], held["number"][second]
            yield from chunks(model.bigram_shards(a, b, held["count"][first]), a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), np.bincount(back))

    def bigrams_file(rows: pa.Table) -> pa.Table:
        keys, (n,) = summed(rows)
        shard = rows.column("shard")[0].as_py()
        put(model.folder, f"bigrams-{shard}", keys.astype("<u8"), n.astype("<u8" if len(n) and n.max() >= 1 << 32 else "<u4"))
        return _summary(shard, len(keys), int(n.sum()), n)

    counted = saved(texts.select("text").mapInArrow(bigrams, CHUNKS).groupBy("shard").applyInArrow(bigrams_file, SUMMARY), "lm-bigrams")
    sums = _totals(spark, counted)
    model.total = sums["n"]
    model.bigram_d = discounts(*(sums[f"n{k}"] for k in (1, 2, 3, 4)))

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                keys, n = mapped(f"{model.folder}/bigrams-{shard}", "count")
                second, before = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
                yield from chunks(np.searchsorted(model.offsets, second, "right") - 1, second, before, kind=0)
                first = keys >> np.uint64(32)
                starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
                sums = [np.add.reduceat(x.astype(np.int64), starts) for x in (n, n == 1, n == 2, n > 2)]
                first = first[starts]
                yield from chunks(np.searchsorted(model.offsets, first, "right") - 1, first, *sums, kind=1)

    def followed_file(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        begin = int(model.offsets[shard])
        size = int(model.offsets[shard + 1]) - begin
        before, behind, gamma = np.zeros(size, "<u8"), np.zeros(size, "<u8"), np.zeros(size, "<f8")
        kinds = rows.column("kind").to_numpy()
        keys, (n,) = summed(rows.filter(pa.array(kinds == 0)))
        before[keys.astype(np.int64) - begin] = n
        keys, (n, *few) = summed(rows.filter(pa.array(kinds == 1)), 4)
        at = keys.astype(np.int64) - begin
        behind[at] = n
        gamma[at] = sum(d * x.astype(np.float64) for d, x in zip(model.bigram_d, few, strict=True)) / np.maximum(n, 1)
        put(model.folder, f"followed-{shard}", np.arange(begin, begin + size, dtype="<u8"), before, behind, gamma)
        return _summary(shard, int(np.count_nonzero(before > 2)), int(before.sum()), before)

    shards = counted.select("shard").repartition(spark.sparkContext.defaultParallelism, "shard")
    known = saved(shards.mapInArrow(followed, CHUNKS).groupBy("shard").applyInArrow(followed_file, SUMMARY), "lm-followed")
    sums = _totals(spark, known)
    model.word_d = discounts(*(sums[f"n{k}"] for k in (1, 2, 3, 4)))
    left = sum(d * x for d, x in zip(model.word_d, (sums["n1"], sums["n2"], sums["n"]), strict=True))
    model.rest = left / model.total if model.total else 1.0
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability) and perplexity."""
    docs = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the numbers only; the arrays stay in their files
    names = [*docs.columns, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, m = Hashes(), sent.value
        for rows, own in portions(batches, most=AT_ONCE):
            hashes, starts = tokens(own, known)
            distinct, inverse, first, second, back = pairs(hashes, starts)
            held = m.words(distinct, followed=True)
            alone = discounted(held["before"], m.word_d) / max(1, m.total) + m.rest / (m.v + 1)
            count = np.zeros(len(first), np.int64)
            both = np.flatnonzero((held["number"][first] >= 0) & (held["number"][second] >= 0))
            count[both] = m.bigrams(held["number"][first[both]], held["number"][second[both]], held["count"][first[both]])
            behind = held["behind"][first]
            p = np.where(behind > 0, discounted(count, m.bigram_d) / np.maximum(behind, 1) + held["gamma"][first] * alone[second], alone[second])
            base = np.log10((held["count"] + 0.1) / (m.n + 0.1 * (m.v + 1)))
            begins = starts - np.arange(len(starts))  # one pair less than tokens with BEGIN in each text
            real = np.ones(len(hashes), bool)
            real[starts] = False
            of_token = inverse[real]
            total = lambda x: np.add.reduceat(x, begins)
            n, score = np.diff(np.append(begins, len(of_token))), total(np.log10(p)[back])
            columns = [
                pa.array(n.astype(np.int64)),
                pa.array(total((held["count"] > 0)[of_token].astype(np.int64))),
                pa.array(np.full(len(n), m.n, np.int64)),
                pa.array(total(base[of_token])),
                pa.array(score),
                pa.array(10.0 ** np.minimum(300.0, -score / n)),
            ]
            yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=names)

    kinds = ["n_tokens long", "n_known long", "train_tokens long", "base_score double", "score double", "perplexity double"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *kinds])
    return docs.mapInArrow(run, schema)


def op11_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Score every whole text of ``documents`` by the model of those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.where(~F.col("held_out")))
    return scored(docs, model).drop("text")
