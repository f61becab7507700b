"""BPE encoding and decoding with forced boundaries.

A pair of adjacent symbols that occurs inside no vocabulary token can never end up in one
token, so it marks a certain cut.  Words are cut there, the fragments are encoded
independently (and remembered), and the results concatenated: the same ids as
from merging the whole word, since no merge reaches across a cut.

The vocabulary is one of the public files of the ``tokenizers`` kind with word
ends: NFC, white space dropped, lower case, words split by pattern, bytes as symbols.  The strings of special
tokens in a text are encoded as those tokens.  Decoding joins the tokens' strings by one space, as
that vocabulary has no decoder.

The driver reads the file once and broadcasts it (a few MB, whatever the corpus).

Defined results: a null or empty text has no ids and decodes to the empty text.  Rows are
encoded one by one, whole, in any number and order; other columns stay, except that ``ids`` and ``decoded`` are replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import table

END = "</w>"
#: Words and fragments remembered by a Python worker; those of the last as many stay when a new lot begins.
REMEMBERED = 200_000
#: Characters of output that a worker gathers before it hands them on.
HELD_CHARS = 4_000_000
#: Longer fragments are merged with a heap.
SHORT = 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256))
    return [chr(b) if b in printable else chr(256 + next(rest)) for b in range(256)]


# Letters and digits of Unicode versions that the vocabulary's word
# pattern does not know yet, though the regular expressions used here do.
NEWER_LETTERS = (
    "\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7"
    "\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f"
    "\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    "\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
    "\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    "\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed"
    "\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
)


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in (vocab | special).items()}
        self.special = special
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.newer = re.compile(f"[{NEWER_LETTERS}]")
        older = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{NEWER_LETTERS}]]").replace(r"\p{N}", rf"[\p{{N}}--[{NEWER_LETTERS}]]")
        self.words_older = regex.compile(older, regex.V1)
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + END] for s in symbols]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << 32 | vocab[b], rank << 32 | vocab[a + b])
        # every pair of symbols that some token holds side by side
        self.joined: set[int] = set()
        for token in vocab:
            bare = token.removesuffix(END) if token != END else token
            ids = [vocab[c] for c in bare]
            if bare != token and ids:
                ids[-1] = vocab[bare[-1] + END]
            self.joined.update(a << 32 | b for a, b in zip(ids, ids[1:], strict=False))
        self.shared = list(range(1 + max(self.strings)))  # one object for each id
        self.words_now: dict[str, tuple[int, ...]] = {}
        self.words_before: dict[str, tuple[int, ...]] = {}
        self.fragments_now: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.fragments_before: dict[tuple[int, ...], tuple[int, ...]] = {}

    def fragments(self, word: str) -> Iterator[tuple[int, ...]]:
        """The symbols of a word, cut at every pair that no token holds."""
        data = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        joined, begin = self.joined, 0
        cuts = [i for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False), 1) if a << 32 | b not in joined]
        for i in cuts:
            yield tuple(ids[begin:i])
            begin = i
        yield tuple(ids[begin:] if begin else ids)

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the pair of lowest rank, leftmost first, until none is left."""
        if len(ids) > SHORT:
            return self._merge_long(ids)
        get, none = self.merges.get, 1 << 63
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            ids[i] = best & 0xFFFFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list."""
        n, get = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(found, i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            found, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = found & 0xFFFFFFFF, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (more := get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (more, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of a word that isn't among the latest."""
        out = self.words_before.get(word)
        if out is None:
            out = tuple(map(self.shared.__getitem__, chain.from_iterable(map(self.fragment, self.fragments(word)))))
        if len(word) <= 100:
            if len(self.words_now) >= REMEMBERED:
                self.words_before, self.words_now = self.words_now, {}
            self.words_now[word] = out
        return out

    def fragment(self, fragment: tuple[int, ...]) -> tuple[int, ...]:
        ids = self.fragments_now.get(fragment)
        if ids is None:
            ids = self.fragments_before.get(fragment)
            if ids is None:
                ids = tuple(map(self.shared.__getitem__, self.merge(list(fragment))))
            if len(self.fragments_now) >= REMEMBERED // 2:
                self.fragments_before, self.fragments_now = self.fragments_now, {}
            if len(fragment) <= 100:
                self.fragments_now[fragment] = ids
        return ids

    @staticmethod
    def normalise(text: str) -> str:
        """NFC, then lower case character by character."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        pieces = self.special_split.split(text) if self.special_split else [text]
        if len(pieces) == 1:
            return self._plain(text)
        return list(chain.from_iterable([self.special[p]] if p in self.special else self._plain(p) for p in pieces if p))

    def _plain(self, text: str) -> list[int]:
        word = self.word
        words = self.words if text.isascii() or not self.newer.search(text) else self.words_older
        out: list[int] = []
        found, at = words.findall(self.normalise(text)), 0
        while at < len(found):  # the latest words may be exchanged meanwhile
            known = self.words_now.get
            out += chain.from_iterable([known(w) or word(w) for w in found[at : at + 1000]])
            at += 1000
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


_CODECS: dict[int, Codec] = {}


def codec(source: str) -> Codec:
    """The codec of a vocabulary, made once by each Python worker."""
    key = hash(source)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(source)
    return _CODECS[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _shipped(docs: DataFrame, path: str | None):
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None, text: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int) of its whole texts; with ``decoded`` also the text that they decode to."""
    shipped, docs = _shipped(docs, path), docs.drop("ids", "decoded")
    names = [*docs.columns, "ids", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shipped.value)
        for batch in batches:
            texts, at = batch.column(text), 0
            while at < len(texts):
                begin, held, ids, back = at, 0, [], []
                while at < len(texts) and held < HELD_CHARS:
                    one = texts[at].as_py()
                    ids.append(own.encode(one))
                    if decoded:
                        back.append(own.decode(ids[-1]))
                    held += 4 * len(ids[-1]) + len(one or "")
                    at += 1
                columns = [*batch.slice(begin, at - begin).columns, pa.array(ids, pa.list_(pa.int32())), *([pa.array(back, pa.string())] * decoded)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "ids array<int>", *["decoded string"] * decoded])
    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with the text that its ``ids`` stand for, as ``decoded``."""
    shipped, encoded = _shipped(encoded, path), encoded.drop("decoded")
    names = [*encoded.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shipped.value)
        for batch in batches:
            back = pa.array([own.decode(x.as_py() or []) for x in batch.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, back], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), "decoded string"])
    return encoded.mapInArrow(run, schema)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode every whole text of ``documents`` and decode it again; digests of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode(docs, decoded=True)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def encoded_documents(docs: DataFrame) -> DataFrame:
    """The pipeline's last stage: ids and their number for every document."""
    columns = [c for c in docs.columns if c != "text"]
    return encode(docs).select(*columns, "ids", F.size("ids").cast("long").alias("n_tokens"))
