"""Alignment of two tokenizers by a galloping intersection of the byte offsets at which their tokens end.

Tokenizer A is a byte-level BPE file of the ``tokenizers`` kind, B a ``sentencepiece`` model.  Of each text, with the space that B
adds before it, both lists of token ends are in bytes.  The shorter list drives: each of its ends is sought in the
longer one by steps that double from where the end before it was found, then by binary search in the last step (all texts
of a portion at once, coarse places first, so each search begins at a place that is known already).  Common ends slice both
lists into groups; differences of the ranks of neighbouring common ends are the groups' lengths, whose products are the links.

A task turns a portion of texts into a block: the block's distinct pairs of ids with the number of its documents that hold
them, and for each document its places in that list with multiplicities.  Only the blocks' distinct pairs are counted over the corpus, and only
they get the counts back, so shuffles carry a pair once for each block and not for each document or link.

Ids of A come from ``tiktoken`` over the same vocabulary where its regular expressions agree with those of ``tokenizers`` (all code points of
``COMMON`` were compared), and from ``tokenizers`` itself otherwise.

Defined results: a null or empty text, and one whose tokens' joined bytes aren't the space and the text (such as one with U+2581), has zeros and an empty
string.  Rows are documents, one by one: rows with one doc_id count each.  Special tokens' strings in a text are plain text.  Long texts are
aligned whole; a group of more than ``WIDE`` links is counted by its distinct ids.  Other columns stay, but those that the result names are replaced.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.bpe import byte_symbols
from lorekeep.llm.common import saved, table
from lorekeep.llm.packed import pack, portions, unpack

#: Bytes of text of a block.
BLOCK = 3_000_000
#: Links of a group beyond which its distinct ids are paired instead of its tokens.
WIDE = 4096
#: Blocks of code points that both implementations of A's pattern were found to class alike.
COMMON = re.compile("[\x00-\u0377\u0400-\u052f\u2000-\u206f\u20a0-\u20bf\u2100-\u214f\u2190-\u23f3\u2500-\u26ff\u2701-\u27bf\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\ufe00-\ufe0f\uff00-\uffbe\U0001f300-\U0001f5ff]*")
# The byte-level word pattern of A.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")
RESULT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class Bytes:
    """The bytes of each id, joined quickly."""

    def __init__(self, strings: list[bytes]) -> None:
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.begins[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class TokenizerA:
    """A byte-level BPE file without special tokens."""

    def __init__(self, source: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(source)
        self.slow = Tokenizer.from_str(source)
        self.slow.encode_special_tokens = True
        of_symbol = {s: b for b, s in enumerate(byte_symbols())}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(map(of_symbol.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        strings = [b""] * (1 + max(ranks.values()))
        for s, i in ranks.items():
            strings[i] = s
        self.bytes, self.size = Bytes(strings), len(strings)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ordered = all(spec["model"]["vocab"][a + b] == 256 + i for i, (a, b) in enumerate(merges))
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered else None

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and COMMON.fullmatch(text):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            except ValueError:  # white space beyond what its pattern matches without a stack
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)


class TokenizerB:
    """A sentencepiece model, which adds a space."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        raw = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.bytes, self.size = Bytes(raw), len(raw)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text), np.int64)


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of ``short`` the first place in ``long`` with no smaller value; both ascend."""
    places, m = np.zeros(len(short), np.int64), len(long)

    def seek(begin: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        low, high = begin.copy(), begin.copy()  # all before low is smaller
        live, step = np.arange(len(begin)), 1
        while len(live := live[(high[live] < m) & (long[np.minimum(high[live], m - 1)] < wanted[live])]):
            low[live] = high[live] + 1
            high[live] += step
            step *= 2
        high = np.minimum(high, m)
        while len(live := np.flatnonzero(low < high)):
            middle = (low[live] + high[live]) >> 1
            less = long[middle] < wanted[live]
            low[live] = np.where(less, middle + 1, low[live])
            high[live] = np.where(less, high[live], middle)
        return low

    if len(short) and m:
        places[:1] = seek(places[:1], short[:1])
        stride = 1 << (len(short) - 1).bit_length()
        while stride:
            own = np.arange(stride, len(short), 2 * stride)
            places[own] = seek(places[own - stride], short[own])
            stride >>= 1
    return places


def common_ends(ends_a: list[np.ndarray], ends_b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, index in A's tokens, index in B's tokens) of every common end, in order; indexes run over all texts.

    The shorter list of each text is the one that drives.
    """
    base, at_a, at_b = 0, 0, 0
    short, long, source, target, text, by_a = [], [], [], [], [], []
    for i, (a, b) in enumerate(zip(ends_a, ends_b, strict=True)):
        one, other = (a, b) if len(a) <= len(b) else (b, a)
        first, second = (at_a, at_b) if len(a) <= len(b) else (at_b, at_a)
        short.append(one + base)
        long.append(other + base)
        source.append(np.arange(first, first + len(one)))
        target.append(np.arange(second, second + len(other)))
        text.append(np.full(len(one), i))
        by_a.append(np.full(len(one), len(a) <= len(b)))
        base += int(a[-1]) if len(a) else 0
        at_a, at_b = at_a + len(a), at_b + len(b)
    if not short:
        return (np.empty(0, np.int64),) * 3
    short, long, source, target, text, by_a = map(np.concatenate, (short, long, source, target, text, by_a))
    places = gallop(short, long)
    hit = np.flatnonzero((places < len(long)) & (long[np.minimum(places, len(long) - 1)] == short)) if len(long) else np.empty(0, np.int64)
    found = target[places[hit]]
    return text[hit], np.where(by_a[hit], source[hit], found), np.where(by_a[hit], found, source[hit])


def linked(ids_a: np.ndarray, ids_b: np.ndarray, text: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, size_a: int, size_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text, pair of ids) in one number each, and how many links are such."""
    begin_a, begin_b = np.concatenate([[0], end_a[:-1] + 1]), np.concatenate([[0], end_b[:-1] + 1])
    n_a, n_b = end_a + 1 - begin_a, end_b + 1 - begin_b
    links, room = n_a * n_b, size_a * size_b
    own = np.flatnonzero(links <= WIDE)
    group = np.repeat(own, links[own])
    within = np.arange(len(group)) - np.repeat(np.cumsum(links[own]) - links[own], links[own])
    keys = text[group] * room + ids_a[begin_a[group] + within // n_b[group]] * size_b + ids_b[begin_b[group] + within % n_b[group]]
    keys, times = np.unique(keys, return_counts=True)
    every, counts = [keys], [times]
    for g in np.flatnonzero(links > WIDE):
        a, of_a = np.unique(ids_a[begin_a[g] : end_a[g] + 1], return_counts=True)
        b, of_b = np.unique(ids_b[begin_b[g] : end_b[g] + 1], return_counts=True)
        every.append((text[g] * room + a[:, None] * size_b + b[None, :]).ravel())
        counts.append((of_a[:, None] * of_b[None, :]).ravel())
    if len(every) > 1:
        keys, back = np.unique(np.concatenate(every), return_inverse=True)
        times, one = np.zeros(len(keys), np.int64), np.concatenate(counts)
        np.add.at(times, back, one)
    return keys, times


class Printer:
    """The digest of the groups of a text."""

    def __init__(self, size_a: int, size_b: int) -> None:
        numbers = [str(i) for i in range(max(size_a, size_b))]
        self.pieces = [n + end for end in (",", "|", ";", "") for n in numbers]  # an id and what comes after it
        self.n = len(numbers)

    def digest(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> str:
        """``end_a`` and ``end_b``: the last token of each group."""
        after_a, after_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        after_a[end_a], after_b[end_b] = 1, 2
        after_b[-1] = 3
        n_a, n_b = np.diff(end_a, prepend=-1), np.diff(end_b, prepend=-1)
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(end_b + 1 - n_b, n_a)] = a + after_a * self.n
        out[np.arange(len(b)) + np.repeat(end_a + 1, n_b)] = b + after_b * self.n
        return hashlib.sha256("".join(map(self.pieces.__getitem__, out.tolist())).encode()).hexdigest()


_LOADED: dict[int, tuple[TokenizerA, TokenizerB, Printer]] = {}


def loaded(a: str, b: bytes) -> tuple[TokenizerA, TokenizerB, Printer]:
    """Both tokenizers, made once by each Python worker."""
    key = hash((a, b))
    if key not in _LOADED:
        _LOADED.clear()
        own = TokenizerA(a), TokenizerB(b)
        _LOADED[key] = (*own, Printer(own[0].size, own[1].size))
    return _LOADED[key]


def same_bytes(ids: list[np.ndarray], raw: list[bytes], of: Bytes) -> np.ndarray:
    """Whether the ids' bytes joined are those of the text."""
    lengths = np.array([int(of.lengths[x].sum()) for x in ids])
    same = lengths == np.array([len(r) for r in raw])
    own = np.flatnonzero(same & (lengths > 0))
    if len(own):
        differ = of.joined(np.concatenate([ids[i] for i in own])) != np.frombuffer(b"".join([raw[i] for i in own]), np.uint8)
        same[own] = ~np.logical_or.reduceat(differ, np.cumsum(lengths[own]) - lengths[own])
    return same


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def blocks(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> tuple[DataFrame, int]:
    """A row for each document with its block, places and their times; and one for each block with its pairs and the number of documents that hold each.

    Also the number of B's ids: a pair is A's id times that and B's id.
    """
    files = [f or d for f, d in zip((path_a, path_b), default_files() if not (path_a and path_b) else (None, None), strict=True)]
    with open(files[0], encoding="utf-8") as f, open(files[1], "rb") as g:
        a, b = f.read(), g.read()
    sent = docs.sparkSession.sparkContext.broadcast((a, b))  # the vocabulary files: a few MB, whatever the corpus
    size_b = TokenizerB(b).size
    docs = docs.drop(*[c.split()[0] for c in RESULT.split(", ")], "n_best", "count_sum", "_block", "_places", "_times", "_pairs", "_held")
    names = [c for c in docs.columns if c != "text"]
    kinds = [docs.schema[c] for c in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), RESULT, "_block long, _places binary, _times binary, _pairs array<long>, _held array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, printer = loaded(*sent.value)
        room, block = one.size * two.size, TaskContext.get().partitionId() << 32
        types = None
        for rows, texts in portions(batches, most=BLOCK):
            raw = [b" " + t if t else b"" for t in texts]
            own_a = [one.encode(" " + t.decode()) if t else np.empty(0, np.int64) for t in texts]
            own_b = [two.encode(t.decode()) if t else np.empty(0, np.int64) for t in texts]
            good = np.flatnonzero(same_bytes(own_a, raw, one.bytes) & same_bytes(own_b, raw, two.bytes) & (np.array([len(r) for r in raw]) > 0))
            own_a, own_b = [own_a[i] for i in good], [own_b[i] for i in good]
            text, end_a, end_b = common_ends([np.cumsum(one.bytes.lengths[x]) for x in own_a], [np.cumsum(two.bytes.lengths[x]) for x in own_b])
            numbers = {name: np.zeros(len(texts), np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
            digests, places, times = [""] * len(texts), [b""] * len(texts), [b""] * len(texts)
            pairs, held = np.empty(0, np.int64), np.empty(0, np.int64)
            if len(good):
                ids_a, ids_b = np.concatenate(own_a), np.concatenate(own_b)
                numbers["n_a"][good] = [len(x) for x in own_a]
                numbers["n_b"][good] = [len(x) for x in own_b]
                numbers["n_groups"][good] = np.bincount(text, minlength=len(good))
                keys, n = linked(ids_a, ids_b, text, end_a, end_b, one.size, two.size)
                of_text = keys // room
                pairs, place, held = np.unique(keys % room, return_inverse=True, return_counts=True)
                cuts = np.searchsorted(of_text, np.arange(len(good) + 1))
                groups = np.searchsorted(text, np.arange(len(good) + 1))
                at_a = at_b = 0
                for j, i in enumerate(good.tolist()):
                    own = slice(cuts[j], cuts[j + 1])
                    places[i], times[i] = pack(place[own], True, 4), pack(n[own], False, 4)
                    numbers["n_links"][i] = n[own].sum()
                    own = slice(groups[j], groups[j + 1])
                    digests[i] = printer.digest(own_a[j], own_b[j], end_a[own] - at_a, end_b[own] - at_b)
                    at_a, at_b = at_a + len(own_a[j]), at_b + len(own_b[j])
            kept = [rows.column(c) for c in names]
            types = types or [c.type for c in kept]
            k = len(texts)
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(x) for x in numbers.values()), pa.array(digests), pa.array(np.full(k, block)), pa.array(places, pa.binary()), pa.array(times, pa.binary()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int32()))],
                names=[*names, *numbers, "groups_sha256", "_block", "_places", "_times", "_pairs", "_held"],
            )
            if len(pairs):
                yield pa.RecordBatch.from_arrays(
                    [*(pa.nulls(1, t) for t in types), *(pa.nulls(1, pa.int64()) for _ in numbers), pa.nulls(1, pa.string()), pa.array([block]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([pairs], pa.list_(pa.int64())), pa.array([held.astype(np.int32)], pa.list_(pa.int32()))],
                    names=[*names, *numbers, "groups_sha256", "_block", "_places", "_times", "_pairs", "_held"],
                )
            block += 1

    return docs.mapInArrow(run, schema), size_b


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``docs`` without text, with n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum."""
    made, size_b = blocks(docs, path_a, path_b)
    made = saved(made, "alignment")
    asked = made.where(F.col("_pairs").isNotNull()).select("_block", F.posexplode(F.arrays_zip("_pairs", "_held")).alias("place", "x")).select("_block", "place", F.col("x._pairs").alias("pair"), F.col("x._held").alias("held"))
    counts = saved(asked.groupBy("pair").agg(F.sum("held").alias("count")), "pair-counts")
    best = counts.groupBy(F.expr(f"pair div {size_b}").alias("a")).agg(F.max("count").alias("most"))
    # a row for each id of A at most: bounded by its vocabulary
    counts = counts.join(F.broadcast(best), F.expr(f"pair div {size_b}") == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = asked.join(counts, "pair").select(F.col("_block").alias("of_block"), "place", "count", "best")
    own = made.where(F.col("_pairs").isNull()).drop("_pairs", "_held")
    names = [c for c in own.columns if c not in ("_block", "_places", "_times")]

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        n = found.num_rows
        count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        place = found.column("place").to_numpy()
        count[place], best[place] = found.column("count").to_numpy(), found.column("best").to_numpy().astype(np.int64)
        of_best, of_count = [], []
        for places, times in zip(rows.column("_places").to_pylist(), rows.column("_times").to_pylist(), strict=True):
            at, t = unpack(places, True, 4).astype(np.int64), unpack(times, False, 4).astype(np.int64)
            of_best.append(int(t @ best[at]))
            of_count.append(int(t @ count[at]))
        return rows.select(names).append_column("n_best", pa.array(of_best, pa.int64())).append_column("count_sum", pa.array(of_count, pa.int64()))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name in names), "n_best long, count_sum long"])
    return own.groupBy("_block").cogroup(answers.groupBy("of_block")).applyInArrow(run, schema)


def op12_cross_tokenizer(spark, sf_dir: str) -> DataFrame:
    """Align every whole text of ``documents`` between the two public tokenizers."""
    return aligned(table(spark, sf_dir, "documents").select("doc_id", "text"))
