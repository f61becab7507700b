"""The training-data operators: edge cases, and brute force where SQL can't express them."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from conftest import rows, same_as_duckdb
from pyspark.sql import functions as F

from lorekeep.llm import ann, bpe, buckets, chat_format, mixing, near_dup, quality, queries, toxicity, url_filter, warc
from lorekeep.llm.common import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    same_as_duckdb(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(rng.randrange(90)) for _ in range(n))


# 1: nearest neighbours


def brute_nearest(vectors, k, every=20):
    out = {}
    for i, q in vectors.items():
        if i % every == 0:
            scored = sorted(((-float(np.dot(q, v)), j) for j, v in vectors.items() if j != i))
            out[i] = [j for _, j in scored[:k]]
    return out


def test_ann_finds_the_nearest(spark, sf):
    got = collections.defaultdict(list)
    for r in ann.op1_ann(spark, sf).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    given = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = brute_nearest(given, 20)
    assert set(got) == set(want)
    recall = np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want])
    assert recall >= 0.95


def test_ann_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 2.0]) for i in range(0, 60)]
    odd = [(100, None), (101, []), (102, [0.0, 0.0]), (103, [nan, 1.0]), (104, [inf, 1.0]), (105, [None, 1.0]), (106, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (120, [5.0, -3.0]), (120, [5.0, -3.0])]
    df = spark.createDataFrame(same + odd, "vec_id long, embedding array<float>").withColumns({"rank": F.lit("x"), "score": F.lit(1), "id": F.lit(2)})
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)), 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    assert set(got) == {0, 20, 40, 120}
    assert [j for _, j in got[0]] == list(range(1, 21)) and [j for _, j in got[20]] == [i for i in range(21) if i != 20]
    assert [j for _, j in got[120]] == list(range(20))
    assert ann.nearest(df.limit(0), F.lit(True), 3).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest(few, F.col("vec_id") == 0, 20).collect()] == [(0, 1)]


def test_chi_square():
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 0.001
    assert abs(ann.chi_square_cdf(7.344, 8) - 0.5) < 0.001


def test_ann_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 256)
    rng = np.random.default_rng(1)
    given = {i: v for i, v in enumerate(rng.normal(size=(3000, 16)))}
    for i in range(1000, 1900):
        given[i] = given[1000]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in given.items()], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    want = brute_nearest(given, 10, 100)
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9
    assert got[1000] == want[1000]


def test_ann_with_a_repeated_id_and_many_copies_of_blocks(spark, monkeypatch):
    """A third of the rows have one id, half of them one vector; blocks are sent again for every seven queries."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 128)
    monkeypatch.setattr(ann, "QUERIES", 7)
    monkeypatch.setattr(ann, "SAMPLE", 400)
    rng = np.random.default_rng(2)
    given = [(i, v) for i, v in enumerate(rng.normal(size=(1000, 16)))]
    given += [(1001, v) for v in rng.normal(size=(250, 16))] + [(1001, np.full(16, 0.5))] * 250
    df = spark.createDataFrame([(i, v.tolist()) for i, v in given], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    recall = []
    for q in range(0, 1000, 20):
        best = {}
        for i, v in given:
            if i != q:
                best[i] = max(best.get(i, -np.inf), float(np.dot(v, given[q][1])))
        want = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:10]
        assert all(abs(best[i] - s) < 1e-9 for i, s in got[q]) and len({i for i, _ in got[q]}) == 10
        recall.append(len({i for i, _ in want} & {i for i, _ in got[q]}) / 10)
    assert np.mean(recall) >= 0.9


def test_runs_are_cut_and_repeats_left_out():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"a": [1, 1, 2, 2], "b": [0, 1, 1, 1], "v": [5, 6, 7, 8]})
    assert [(k, r.column("v").to_pylist()) for k, r in ann.runs(batch, ["a", "b"])] == [([1, 0], [5]), ([1, 1], [6]), ([2, 1], [7, 8])]
    assert list(ann.runs(batch.slice(0, 0), ["a", "b"])) == []
    ids, x = np.array([1, 1, 1, 2]), np.array([[1.0], [1.0], [2.0], [2.0]])
    first = ann.unlike_previous(ids, x, [])
    assert first[0].tolist() == [1, 1, 2] and first[1].ravel().tolist() == [1.0, 2.0, 2.0]
    assert ann.unlike_previous(ids[3:], x[3:], [first])[0].tolist() == []


# 2: near duplicates


def brute_classes(texts, threshold=0.8):
    bags = []
    for t in texts:
        w = near_dup.words_of(t)
        bags.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both, either = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
        if either and both / either >= threshold:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(0)
    gaps = []
    for _ in range(20):
        h = rng.integers(0, 2**63, 60).astype(np.uint64)
        a, b = rng.integers(0, 7, 60).astype(float), rng.integers(0, 7, 60).astype(float)
        shingle = np.concatenate([h[a > 0], h[b > 0]])
        weight = np.concatenate([a[a > 0], b[b > 0]])
        doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        s = near_dup.bag_minhash(shingle, weight, doc, 2, 1000)
        gaps.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(gaps)) < 0.01


def near_copies(rng):
    texts = []
    for _ in range(25):
        base = words(rng, rng.randrange(8, 150)).split()
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("part", [7, 512])
def test_near_duplicates_like_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(buckets, "PART", part)
    rng = random.Random(4)
    texts = near_copies(rng)
    hot = words(rng, 120).split()
    for i in range(60):  # a large group around one text, some of it out of reach
        copy = list(hot)
        for _ in range(i % 7):
            copy[rng.randrange(len(copy))] = f"hot{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [words(rng, 20)] * 40 + ["One, two!", "one two", "one two three", "", None, None, "a b c d e " * 30, "a b c d e " * 31]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n": F.lit(1), "digest": F.lit("x"), "bucket": F.lit(2)})
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(df).collect()}
    want = brute_classes(texts)
    assert [got[i] for i in range(len(texts))] == want
    kept = near_dup.first_of_each_class(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want)) and kept.columns == df.columns


def test_near_duplicate_edge_cases(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "x y z u v w q"), (2, "A b, c d e f g"), (3, "x y z u v w q!"), (None, "a b c d e f g"), (9, "é" * 5000)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["class_id"]) for r in near_dup.near_duplicates(df).collect())
    assert got == [(-1, None), (1, 1), (1, 1), (2, 1), (3, 1), (9, 9)]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0
    long = [words(random.Random(k), 100_000) for k in (1, 2)]
    df = spark.createDataFrame([(1, long[0]), (2, long[0] + " one more"), (3, long[1]), (4, " ".join(long[0].split()[:80_500])), (5, " ".join(long[0].split()[:79_000]))], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 1}


def executions(spark) -> list[int]:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [found.apply(k).executionId() for k in range(found.size())]


def joined_rows(spark, after: int, what: str) -> int:
    """Rows that joins whose description holds ``what`` made in the executions after that one."""
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    for i in (i for i in executions(spark) if i > after):
        values, nodes = store.executionMetrics(i), store.planGraph(i).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if "Join" in node.name() and what in re.sub(r"#\d+L?", "", node.desc()):
                metrics = node.metrics()
                ids = [m.accumulatorId() for m in (metrics.apply(k) for k in range(metrics.size())) if m.name() == "number of output rows"]
                made += sum(int(values.apply(m).replace(",", "")) for m in ids if values.contains(m))
    return made


def test_rows_of_large_buckets_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(buckets, "PART", 64)
    rng, n = random.Random(9), 120
    base, texts = words(rng, 120).split(), []
    for i in range(n):
        texts.append(" ".join([*base[: i % 120], f"own{i}", *base[i % 120 + 1 :]]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    before = max([-1, *executions(spark)])
    got = near_dup.near_duplicates(df).collect()
    assert len(got) == n and {r["class_id"] for r in got} == {0}
    assert 0 < joined_rows(spark, before, "[bucket], [bucket], LeftOuter") < near_dup.BANDS * n  # five times the rows of all buckets, when each use of them joined the sizes anew


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    roots = {r["node"]: r["root"] for r in near_dup.components(df).collect()}
    assert len({roots[i] for i in range(41)}) == 1 and len({roots[100 + i] for i in range(30)}) == 1 and len(set(roots.values())) == 2


# 3: url rules


def test_url_edge_cases(spark):
    urls = [
        (1, None), (2, "no scheme"), (3, "http://EXAMPLE.org"), (4, "http://a.Example.org/es/x?y=/z"), (5, "x://y://z.org/"), (6, "http://notexample.org/es/"), (7, "http://org/"), (8, "https://b.com/de/#f"),
        (9, "http://example.org/en/123"), (9, "http://example.org/en/123"), (10, "http://c.com?x=/fr/"), (None, "http://c.com/fr/"), (11, "http://" + "a." * 500 + "com/fr/" + "x" * 5000),
    ]
    df = spark.createDataFrame(urls, "page_id long, url string").withColumns({"rule": F.lit("old"), "host": F.lit("old"), "block": F.lit(1)})
    rules = spark.createDataFrame(url_filter.OP3_RULES, "host string, path string, verdict string")
    got = {(r["page_id"], r["url"]): (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, rules).collect()}
    by = {k[0]: v for k, v in got.items()}
    assert by[1] == by[2] == ("", "", None, "allow")
    assert by[3] == ("example.org", "", None, "allow")
    assert by[4] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert by[5] == ("y:", "//z.org/", None, "allow")
    assert by[6][2:] == ("org/", "allow") and by[7][2:] == ("org/", "allow") and by[8][2:] == ("com/de/", "block")
    assert by[9][2:] == ("example.org/en/1", "block") and by[10][2:] == (None, "allow") and by[None][2:] == ("com/fr/", "allow") and by[11][2] == "com/fr/"
    assert url_filter.judge_urls(df, rules).count() == len(urls)
    assert url_filter.judge_urls(df, rules.limit(0)).where("verdict = 'allow' AND rule IS NULL").count() == len(urls)
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0


def test_filter_has_no_false_negatives(spark):
    many = spark.range(3000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".net")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), F.col("id") * 2, F.lit(".net/x")).alias("url"))
    assert url_filter.judge_urls(pages, many).where("verdict = 'block'").count() == 1500


# 4 and 5: classifiers


def labelled(rng, n=400):
    docs, labels = [], []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 7 == 0
        text = words(rng, 80)
        text = " ".join(w.upper() + "!!" for w in text.split()) if bad else text
        text += " you are an idiot and a grblx%d fool" % i if toxic else ""
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, module, label):
    docs, labels = labelled(random.Random(2))
    odd = [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "x " * 60000, "en", "s", 1), (1003, "same text", "en", "s", 9), (1003, "same text", "en", "s", 9), (None, "no id", "en", "s", 5)]
    df = spark.createDataFrame(docs + odd, DOCS).withColumns({"score": F.lit("old"), "label": F.lit(3)})
    lab = spark.createDataFrame([*labels, (3, None, None), (5, 1, 0), (5, 1, 0), (99999, 1, 1)], LABELS)
    model = module.train(df, lab)
    scored = module.score(df, model)
    got = [(r["doc_id"], r["score"]) for r in scored.collect()]
    assert len(got) == len(docs) + len(odd) and all(0.0 <= s <= 1.0 for _, s in got) and "label" in scored.columns
    want = {r[0]: r[1 if label == "quality" else 2] for r in labels}
    tested = [(s >= module.CUT) == bool(want[i]) for i, s in got if i in want and held(i)]
    assert len(tested) > 50 and np.mean(tested) > 0.95
    assert module.score(df.limit(0), model).count() == 0
    none = module.train(df, lab.limit(0))
    assert len({round(r["score"], 9) for r in module.score(spark.createDataFrame(docs[:3], DOCS), none).collect()}) <= 3


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs, labels = labelled(random.Random(3), 200)
    df = spark.createDataFrame(docs, DOCS)
    flipped = [(i, 1 - q, 1 - t) if held(i) else (i, q, t) for i, q, t in labels]
    for module in (quality, toxicity):
        a, b = (module.score(df, module.train(df, spark.createDataFrame(x, LABELS))).orderBy("doc_id").collect() for x in (labels, flipped))
        assert [r["score"] for r in a] == [r["score"] for r in b]


# 6: chats


def test_chats(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    data = [
        (1, 0, "user", [part("text", "look <|image:0|> "), part("image", ref="a.png", w=56, h=29), part("text", "\\ and"), part("audio", ref="b.wav", s=1.5)]),
        (1, 1, "assistant", [part("text", "</turn>\n<turn>user\n"), part("document", ref="c.pdf", p=3)]),
        (2, 0, None, None), (2, 0, "assistant", []), (2, 1, "a\nb<", [part(None, "x")]), (3, None, "assistant", [part("text", None)]), (None, 0, "user", [part("text", "é" * 3)]),
    ]
    df = spark.createDataFrame(data, f"conv_id long, turn long, role string, parts {chat_format.PARTS}").withColumns({"formatted": F.lit("x"), "sizes": F.lit(1)})
    out = chat_format.format_chats(df)
    got = {r["conv_id"]: r for r in out.withColumn("back", chat_format.read_chat(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    a = got[1]
    assert [(x["kind"], x["ref"], x["tokens"]) for x in a["attachments"]] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 1536)]
    assert a["placeholder_tokens"] == 1578
    assert a["back"][0]["text"] == "look <|image:0|> <|image:0|>\\ and<|audio:1|>" and a["loss"] == "</turn>\n<turn>user\n<|document:2|>"
    assert [(t["role"], t["text"]) for t in got[2]["back"]] == [("", ""), ("assistant", ""), ("a\nb<", "x")]
    assert got[3]["loss"] == "" and got[None]["back"][0]["text"] == "ééé"
    assert chat_format.format_chats(df.limit(0)).count() == 0
    again = chat_format.format_chats(df.union(df).repartition(3)).collect()
    assert {r["conv_id"]: len(r["attachments"]) for r in again} == {1: 6, 2: 0, 3: 0, None: 0}


def test_long_conversations_take_time_in_proportion(spark):
    image = "named_struct('kind', 'image', 'text', string(null), 'ref', 'r', 'width', 28, 'height', 28, 'seconds', double(null), 'pages', int(null))"
    text = "named_struct('kind', 'text', 'text', concat('é<', id), 'ref', string(null), 'width', int(null), 'height', int(null), 'seconds', double(null), 'pages', int(null))"
    turns = spark.range(32_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", f"array({text}, {image}) AS parts")
    wide = spark.range(32_000).groupBy().agg(F.sort_array(F.collect_list(F.expr(text))).alias("t")).selectExpr("2L AS conv_id", "0L AS turn", "'assistant' AS role", "t AS parts")
    began = time.time()
    chats = chat_format.format_chats(turns.union(wide))
    got = {r["conv_id"]: r for r in chats.select("conv_id", F.size(chat_format.read_chat(F.col("formatted"))).alias("turns"), F.sha2(chat_format.loss_text(F.col("formatted"), F.col("loss_spans")), 256).alias("loss"), F.get("attachments", F.lit(31_999))["index"].alias("last"), "placeholder_tokens", F.size("loss_spans").alias("spans")).collect()}
    assert time.time() - began < 60
    said = "".join(f"é<{i}<|image:{i}|>" for i in range(1, 32_000, 2))
    assert tuple(got[1])[1:] == (32_000, hashlib.sha256(said.encode()).hexdigest(), 31_999, 32_000, 16_000)
    assert (got[2]["turns"], got[2]["last"], got[2]["spans"]) == (1, None, 1)


# 8: tokens


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_bpe_like_the_library(spark, sf):
    t = library()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in bpe.op8_bpe(spark, sf).collect():
        ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_texts():
    t, c = library(), bpe.codec(open(bpe.default_vocabulary(), encoding="utf-8").read())
    pieces = ["a", "Éé", "e\u0301", "ΑΣ", "İ", "ß", "\x1c", "\x85", "\u200b", "\u00a0", "²", "½", "Ⅳ", "日本", "😀", "👨‍👩‍👧", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|>", "'s", "'LL", "!!!", "\n", "_", "WORLD", "\x00", "ǅ", "हिन्दी"]
    rng = random.Random(1)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(3000)] + ["!" * 3000 + "ab" * 3000, "x" * 9000, ""]
    for text in texts:
        e = t.encode(text, add_special_tokens=False)
        assert c.encode(text) == e.ids, text
        assert c.decode(e.ids) == t.decode(e.ids, skip_special_tokens=False)


def test_cuts_do_not_change_the_result():
    c = bpe.codec(open(bpe.default_vocabulary(), encoding="utf-8").read())
    rng = random.Random(5)
    for _ in range(500):
        word = "".join(rng.choice("abéñüzxqjkthe") for _ in range(rng.randrange(1, 30)))
        whole = [c.inner[b] for b in word.encode()]
        whole[-1] = c.last[word.encode()[-1]]
        assert list(c.word(word)) == c.merge(list(whole)) == c._merge_long(list(whole))


def test_bpe_frame(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b")], "doc_id long, text string").withColumns({"ids": F.lit("old"), "n": F.lit(1)})
    out = bpe.encode(df)
    assert [len(r["ids"]) for r in out.orderBy("doc_id").collect()] == [0, 0, 2, 2] and set(out.columns) == {"doc_id", "text", "n", "ids"}
    assert [r["decoded"] for r in bpe.decode(out).orderBy("doc_id").collect()] == ["", "", "a</w> b</w>", "a</w> b</w>"]
    assert bpe.encode(df.limit(0)).count() == 0


# 9: mixing


def fill(sizes, weights, total, epochs):
    """Clamp and share again until none is above its cap."""
    target, open_ = {}, set(sizes)
    while True:
        rest = total - sum(target.values())
        weight = sum(weights[s] for s in open_)
        share = {s: rest * weights[s] / weight for s in open_}
        over = {s for s in open_ if share[s] > epochs * sizes[s]}
        if not over:
            return target | share
        target |= {s: epochs * sizes[s] for s in over}
        open_ -= over


@pytest.mark.parametrize("sf_name", ["sf0.001", "sf0.01"])
def test_mix(spark, sf_name):
    got = mixing.op9_mixing(spark, f"/root/testdata/{sf_name}").toPandas()
    by = got.groupby("source").agg(size=("size", "sum"), told=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    names = sorted(by.index)
    want = fill(by["size"].to_dict(), {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * by["size"].sum(), 2.0)
    for s in names:
        assert by.loc[s, "size"] == by.loc[s, "told"]
        assert abs(by.loc[s, "target"] - want[s]) < 1e-6 * want[s]
        assert abs(by.loc[s, "taken"] - want[s]) < 0.02 * want[s]
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] == got["size"] * got["epochs"]).all()
    assert rows(got)[1] == rows(mixing.op9_mixing(spark, f"/root/testdata/{sf_name}"))[1]


def test_mix_edge_cases(spark):
    data = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "one", None), (5, "d " * 500, "y"), (5, "d " * 500, "y"), (None, "z z", "y"), (6, "a\u00a0b", "")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumns({"size": F.lit(7), "cut": F.lit(8), "_bin": F.lit(9), "level": F.lit(1)})
    out = mixing.mix(df, **mixing.OP9).collect()
    assert len(out) == len(data) and sum(r["size"] for r in out) == 3 + 0 + 0 + 1 + 500 + 500 + 2 + 1
    assert all(r["taken"] <= 2 * r["size"] and r["cut"] == 8 for r in out)
    copies = mixing.mixed_documents(df)
    assert copies.columns == df.columns and copies.where("size <> 7").count() == 0
    assert mixing.mix(df.limit(0), **mixing.OP9).count() == 0


# 10: archives


def test_archives(spark):
    data = [(1, "http://a/", "x" * 2000), (2, "http://b/", "x" * 2000), (3, None, None), (4, "u\r\nx", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 50), (5, "u", "é" * 900), (6, "v", "é" * 900), (6, "v", "é" * 900), (7, "s", "y" * 999), (8, "s", "y" * 999), (None, "n", "x" * 2000)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({"n": F.lit(1), "digest": F.lit(2)})
    path = new_path(spark, "warc")
    warc.write_archive(df, path)
    got = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(got) == len(data)
    texts = {(i, len((h or "").encode())): (h or "").encode() for i, _, h in data}
    for r in got:
        c = r["capture"]
        assert r["request"]["text"].startswith("GET ") and "payload-length" in r["metadata"]["text"]
        if c["kind"] == "response":
            assert bytes(c["block"]) == texts[c["page_id"], c["payload_bytes"]]
    kinds = sorted((r["capture"]["page_id"] or -1, r["capture"]["kind"], r["capture"]["refers_to"]) for r in got)
    assert [k for k in kinds if k[1] == "revisit"] == [(-1, "revisit", 2), (1, "revisit", 2), (5, "revisit", 6)]
    empty = new_path(spark, "warc")
    warc.write_archive(df.limit(0), empty)
    assert warc.assemble(warc.read_records(spark, empty)).count() == 0


def test_broken_archives():
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc._records(b"junk" + record + record)] == [b"abc", b"abc"]
    assert [b for _, b in warc._records(record + record[:-8])] == [b"abc"]
    assert list(warc._records(b"")) == [] and list(warc._records(b"WARC/1.1\r\n")) == []


# the pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "toxicity", "near_dup", "mixing", "bpe"] and p.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kinds = []
    for _, stage in p.STAGES:
        path = new_path(spark, "stage")
        stage(spark, docs, sf).write.parquet(path)
        docs, before = spark.read.parquet(path), docs
        kinds.append((before, docs))
    plain = quality.op4_quality(spark, sf).where("predicted = 1").select("doc_id")
    assert rows(kinds[0][1].select("doc_id")) == rows(plain)
    for _, after in kinds[:4]:
        assert after.columns == p.COLUMNS
    texts = kinds[1][1].orderBy("doc_id").collect()
    first = {c for c in brute_classes([r["text"] for r in texts])}
    assert {r["doc_id"] for r in kinds[2][1].collect()} == {texts[i]["doc_id"] for i in first}
    assert kinds[4][1].count() == kinds[3][1].count() == p.run(spark, sf).count()
    t = library()
    for r in kinds[4][1].join(kinds[3][1].select("doc_id", "text").distinct(), "doc_id").limit(40).collect():
        assert list(r["ids"]) == t.encode(r["text"], add_special_tokens=False).ids


def test_ann_brings_no_vectors_to_the_driver(spark, monkeypatch):
    rng = random.Random(13)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(40)]) for i in range(200)], "vec_id long, embedding array<double>")
    seen, given = [], type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: (seen.append(given(self)), seen[-1])[1])
    assert ann.nearest(df, F.col("vec_id") % 20 == 0, 3).count() == 30
    assert seen and all(t.column_names == ["p"] and len(t["p"][0]) == ann.PROJECTIONS for t in seen)
