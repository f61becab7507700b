"""Language-model scores, tokenizer alignment and lexical search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lorekeep.llm import align, lexical, lm, packed

WORDS = ["the", "The", "cat", "sat", "on", "a", "mat", "dog", "ÉTÉ", "été", "x1"]


def texts(rng, n, words=WORDS):
    return [" ".join(rng.choices(words, [1 / (1 + i) for i in range(len(words))], k=rng.randint(0, 25))) for _ in range(n)]


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


# language model


def model_by_hand(train):
    """Interpolated modified Kneser-Ney over dictionaries; a function of (word before, word)."""
    lower = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
    cut = lambda t: [lower(w) for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] + [" "]
    big, uni = Counter(), Counter()
    for t in train:
        ws = cut(t)
        uni.update(ws)
        big.update(zip(["", *ws], ws, strict=False))
    before = Counter(w for _, w in big)

    def discount(counts):
        n = [sum(c == k for c in counts) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        return [0.0] + [min(k, max(0.1, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] and y else k / 2 for k in (1, 2, 3)]

    d2, d1 = discount(big.values()), discount(before.values())
    v, total = len(uni), sum(before.values())
    rest = sum(d1[min(c, 3)] for c in before.values()) / total if total else 1.0
    p1 = lambda w: (max(before[w] - d1[min(before[w], 3)], 0) / total if total else 0) + rest / (v + 1)
    after = defaultdict(list)
    for (h, _), c in big.items():
        after[h].append(c)

    def p(h, w):
        if h not in after:
            return p1(w)
        c, s = big[h, w], sum(after[h])
        return max(c - d2[min(c, 3)], 0) / s + sum(d2[min(x, 3)] for x in after[h]) / s * p1(w)

    return p, uni, cut


@pytest.mark.parametrize("hot", [200_000, 3])
def test_lm_like_dictionaries(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(packed, "SHARD_BYTES", 800)  # several shards
    rng = random.Random(1)
    rows = list(enumerate([*texts(rng, 150), None, "", "  \t\n ", "unseen words only", "the " * 3000, "a b the\x0bcat"]))
    rows += [(3, rows[3][1]), (None, "the cat"), (3, "another text of id 3")]
    df = frame(spark, [(i, t, n, 7) for n, (i, t) in enumerate(rows)], ", place long, score long").repartition(3)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    train = [t for i, t in rows if not held(i)]
    p, uni, cut = model_by_hand(train)
    model = lm.train(df.where(~lm.held_out(df["doc_id"])))
    got = {r["place"]: r for r in lm.scored(df, model).collect()}
    n, v = sum(uni.values()), len(uni)
    assert len(got) == len(rows) and model.bits > 1
    for place, (_, text) in enumerate(rows):
        ws = cut(text)
        r = got[place]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(uni[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        want = sum(math.log10(p(h, w)) for h, w in zip(["", *ws], ws, strict=False))
        assert r["score"] == pytest.approx(want, rel=1e-9) and r["perplexity"] == pytest.approx(10 ** (-want / len(ws)), rel=1e-6)
    for h in ("the", "", "mat", "never seen"):
        assert sum(p(h, w) for w in uni) + p(h, "some unknown word") == pytest.approx(1.0)


def test_lm_without_training_rows(spark):
    df = frame(spark, [(1, "a b"), (2, None)])
    model = lm.train(df.limit(0))
    assert {r["doc_id"]: (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in lm.scored(df, model).collect()} == {1: (3, 0, 0, 0.0, 0.0), 2: (1, 0, 0, 0.0, 0.0)}
    assert lm.scored(df.limit(0), model).count() == 0


def test_lm_beats_the_base(spark, sf):
    r = lm.op11_lm_scoring(spark, sf).toPandas()
    own = r[r["held_out"]]
    assert len(own) and own["score"].sum() > 1.1 * own["base_score"].sum()


def test_lm_needs_a_mounted_folder():
    with pytest.raises(ValueError, match="mounted"):
        lm.local_folder("hdfs://name/x")


# alignment


def alignment_by_hand(rows):
    """(doc, n_a, n_b, n_groups, n_links, digest, n_best, count_sum) of texts, by dictionaries."""
    a_file, b_file = align.default_files()
    one = Tokenizer.from_file(a_file)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=b_file)
    own_a, own_b = align.TokenizerA(open(a_file, encoding="utf-8").read()).bytes, align.TokenizerB(open(b_file, "rb").read()).bytes
    held, counts = [], Counter()
    for t in rows:
        a, b = (one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)) if t else ([], [])
        if not t or any(x.joined(np.array(i)).tobytes() != (" " + t).encode() for i, x in ((a, own_a), (b, own_b))):
            held.append(None)
            continue
        ends_a, ends_b = own_a.lengths[a].cumsum().tolist(), own_b.lengths[b].cumsum().tolist()
        groups, i, j = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        links = Counter()
        for x, y in groups:
            for p, n in Counter(x).items():
                for q, k in Counter(y).items():
                    links[p, q] += n * k
        counts.update(links.keys())
        held.append((a, b, groups, links))
    most = defaultdict(int)
    for (p, _), n in counts.items():
        most[p] = max(most[p], n)
    for x in held:
        if x is None:
            yield (0, 0, 0, 0, "", 0, 0)
        else:
            a, b, groups, links = x
            told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            yield (len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(told.encode()).hexdigest(), sum(n for k, n in links.items() if counts[k] == most[k[0]]), sum(n * counts[k] for k, n in links.items()))


def test_alignment_like_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(align, "BLOCK", 2_000)  # several blocks
    rng = random.Random(2)
    odd = [None, "", " ", "   a  b ", "<|endoftext|> and <s> </s> <unk>", "a ▁ b", "<0x41>", "naïve café — “quoted” 東京 한국 🙂👍🏽", "\x00\n\t\r", "é ﬁ ½", "ꟑ \U0001e4d0 newer letters", "x" * 3000, "ab" * 5000, " " * 20_000, "ا" * 900, "Ⅷ ㍿" * 50]
    odd.append("".join(chr(rng.choice([0x4E00, 0x1F600, 0x410, 0x61, 0x20, 0xE9])) for _ in range(4000)))
    own = [*odd, *texts(rng, 60), *["the cat sat"] * 3]
    df = frame(spark, [(n if n % 7 else 7, t, n, 1) for n, t in enumerate(own)], ", place long, n_a long").repartition(4)
    got = {r["place"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"], r["n_best"], r["count_sum"]) for r in align.aligned(df).collect()}
    want = list(alignment_by_hand(own))
    assert [got[i] for i in range(len(own))] == want
    assert sum(w[0] == 0 for w in want) < 8
    monkeypatch.setattr(align, "WIDE", 3)  # groups by their distinct ids
    again = {r["place"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"], r["n_best"], r["count_sum"]) for r in align.aligned(df).collect()}
    assert again == got
    assert align.aligned(df.limit(0)).count() == 0 and align.aligned(df.where("text IS NULL")).count() == 1


def test_gallop():
    rng = np.random.default_rng(3)
    for n, m in ((0, 5), (5, 0), (1, 1), (3, 1000), (500, 700), (1000, 3)):
        short, long = (np.unique(rng.integers(0, 3000, k)) for k in (n, m))
        assert align.gallop(short, long).tolist() == np.searchsorted(long, short).tolist()


def test_both_encoders_of_a_agree(sf, spark):
    a = align.TokenizerA(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    assert a.fast is not None
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        assert a.encode(" " + r["text"]).tolist() == a.slow.encode(" " + r["text"], add_special_tokens=False).ids


# lexical search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def search_by_hand(docs, items, k=20):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    cut = lambda t: Counter(TERM.findall((t or "").translate(lower)))
    held = [(i, cut(t)) for i, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + 25 * c.total() * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * q * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in cut(text).items() if c[t])
            if s > 0:
                scores.append((-s, i))
        for rank, (s, i) in enumerate(sorted(scores)[:k], 1):
            yield item, rank, i, -s


def test_search_like_all_documents(spark, monkeypatch):
    monkeypatch.setattr(lexical, "WIDTH", 16)
    monkeypatch.setattr(lexical, "PROBES", 25)
    rng = random.Random(4)
    words = [f"t{i}" for i in range(300)] + ["Éa", "été", "x_y", "naïve", "A1"]
    docs = list(enumerate([*texts(rng, 500, words), None, "", "--- !!", "t0 " * 4000, "t1," * 60 + "T2", *["same text t5 t6"] * 30]))
    items = [(0, "t0 t1 t2 t250"), (1, "T5 t5 t6"), (2, None), (3, "absent"), (4, "naïve ÉTÉ été x_y"), (5, ""), (6, " ".join(words)), (7, "t299.t298/t297")]
    df = frame(spark, [(i, t, 5, "x") for i, t in docs], ", rank int, item_id string").repartition(4)
    got = sorted(tuple(r) for r in lexical.search(df, spark.createDataFrame(items, "item_id long, text string")).select("item_id", "rank", "doc_id", "score").collect())
    assert got == sorted(search_by_hand(docs, items))
    monkeypatch.setattr(lexical, "ITEM_BYTES", 40)  # several blocks of items
    monkeypatch.setattr(lexical, "SUMMED", 50)
    again = sorted(tuple(r) for r in lexical.search(df, spark.createDataFrame(items, "item_id long, text string")).select("item_id", "rank", "doc_id", "score").collect())
    assert again == got


def test_search_of_odd_rows(spark):
    items = spark.createDataFrame([(None, "apple"), (1, "apple"), (1, "pear")], "item_id long, text string")
    docs = frame(spark, [(2, "apple pie"), (2, "apple pie"), (None, "apple pie"), (1, "pear tree"), (5, "fig")])
    found = lexical.search(docs, items).collect()
    assert sorted((r["item_id"] or 0, r["rank"], r["doc_id"] or 99) for r in found) == [(0, 1, 2), (0, 2, 2), (0, 3, 99), (1, 1, 1), (1, 1, 2), (1, 2, 2), (1, 3, 99)]
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


def test_bounds_are_upper_bounds_and_tell_documents_apart(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = [(r["item_id"], r["text"].encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:10]
    asked = lexical.Questions(items)
    counted = [Counter(lexical.found_terms(d["text"].encode())) for d in docs]
    df = np.array([sum(t in c for c in counted) for t in asked.places])
    asked.learn(len(docs), sum(c.total() for c in counted), df)
    held = [(np.array([lexical.Hashes()[t] for t in c], np.uint64), np.array(list(c.values()))) for c in counted]
    entries = max(sum(int((tf >= s).sum()) for s in lexical.STEPS) for _, tf in held)
    rows = lexical.ROWS << (entries - 1).bit_length()
    bits = lexical.matrix(held, rows)
    lengths = np.array([c.total() for c in counted])
    left = 0
    for number, bound in asked.bounds(rows, bits, lengths):
        scores = np.array([asked.scores(d["text"].encode(), [number])[0] for d in docs])
        assert (bound >= scores).all()
        left += int((bound >= np.sort(scores)[-20]).sum())
    assert left < 0.6 * 10 * len(docs)


# urls


def test_hosts_of_very_many_labels(spark):
    import time

    from lorekeep.llm import url_filter

    long = "https://" + "a." * 100_000 + "example.org/es/x"
    pages = spark.createDataFrame([(1, long), (2, "http://example.org/es/"), (3, "https://x.notexample.org/es/"), (4, "https://" + "." * 50_000 + "fr/"), (5, "https://b.a.example.org/en/1?q")], "page_id long, url string")
    rules = spark.createDataFrame([*url_filter.OP3_RULES, ("a.example.org", "/en/1", "allow")], "host string, path string, verdict string")
    began = time.time()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: ("example.org/es/", "block"), 3: ("org/", "allow"), 4: (None, "allow"), 5: ("a.example.org/en/1", "allow")}
    assert time.time() - began < 60


def test_common_code_points_are_split_alike():
    a = align.TokenizerA(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000 and align.COMMON.fullmatch(chr(c))]
    texts = [form.replace("{}", c) for c in points[:: len(points) // 3000] for form in ("a{} 1{} {}.  {}b", "{}'s{}")]
    slow = [e.ids for e in a.slow.encode_batch(texts, add_special_tokens=False)]
    assert [a.encode(t).tolist() for t in texts] == slow
