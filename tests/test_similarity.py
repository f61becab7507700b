"""Similarity joins against all pairs; consolidation on any type of id."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import COLUMNS, memory

from lorekeep import schema as S
from lorekeep.operators import cluster, setjoin


def as_sets(rows):
    return {i: {w for w in (t or "").lower().split() + (c or "").lower().split() if len(w) >= 3} for i, t, c in rows}


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 1.0])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_jaccard_like_all_pairs(spark, threshold, kind):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(30)]
    rows = []
    for i in range(90):
        own = rng.sample(words, rng.randint(1, 14)) if i < 30 or rng.random() < 0.3 else [w for w in rows[rng.randrange(len(rows))][2].split() if rng.random() < 0.9] + rng.sample(words, rng.randint(0, 2))
        rows.append((i if kind == "long" else f"m-{i:03}", rng.choice(["", None, "note"]), " ".join(own)))
    rows += [(x if kind == "long" else f"m-{x}", None, "of a it") for x in (900, 901)]
    df = spark.createDataFrame(rows, f"id {kind}, title string, content string")
    sets, want = as_sets(rows), {}
    for i, a in enumerate(sorted(sets)):
        for b in sorted(sets)[i + 1 :]:
            if sets[a] and sets[b] and (s := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= threshold - 1e-12:
                want[a, b] = round(s, 9)
    got = [(r["a"], r["b"], round(r["similarity"], 9)) for r in setjoin.jaccard_pairs(df, threshold).collect()]
    assert len(got) == len(want) and {(a, b): s for a, b, s in got} == want
    for bad in (0.0, 1.1):
        with pytest.raises(ValueError, match="threshold"):
            setjoin.jaccard_links(df, bad)


def test_copies_do_not_meet(spark):
    df = spark.range(500).selectExpr("id", "'same title' AS title", "if(id % 2 = 0, 'alpha beta gamma', 'alpha beta gamma delta') AS content")
    links, classes = setjoin.jaccard_links(df, 0.8)
    assert [tuple(r) for r in links.collect()] == [(0, 1, 5 / 6)] and classes.count() == 500
    assert setjoin.candidates(setjoin.ordered(setjoin.token_classes(df).where("id = class").select("id", "words")), 0.8).count() == 1
    assert setjoin.jaccard_links(df.limit(0), 0.8)[0].count() == 0


def test_pairs_that_share_rare_words_alone_are_not_verified(spark, monkeypatch):
    rng = random.Random(9)
    common = [f"common{i}" for i in range(400)]
    rows = [(i, "", " ".join([f"rare{i // 2}x{j}" for j in range(6)] + rng.sample(common, 60))) for i in range(120)]
    rows += [(1000 + i, "", rows[i][2] + " more") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, title string, content string")
    seen, verified = [], setjoin.verified_in_parts
    monkeypatch.setattr(setjoin, "verified_in_parts", lambda pairs, sets: (seen.append(pairs.count()), verified(pairs, sets))[1])
    monkeypatch.setattr(setjoin, "PART", 2_000)
    links, classes = setjoin.jaccard_links(df, 0.8)
    assert {(r["a"], r["b"]) for r in links.collect()} == {(i, 1000 + i) for i in range(10)} and classes.count() == 130
    assert seen == [10]


def test_pair_similarity_has_one_measure(spark):
    df = spark.createDataFrame([(1, "aaa bbb", ""), (2, "bbb ccc", None), (3, "", "")], "id long, title string, content string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 3)], "a long, b long")
    found, measure = setjoin.pair_similarity(pairs, df)
    assert measure == "lexical" and {(r["a"], r["b"]): round(r["similarity"], 3) for r in found.collect()} == {(1, 2): 0.333, (1, 3): 0.0, (3, 3): 0.0}
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0])], "id long, vector array<double>")
    found, measure = setjoin.pair_similarity(pairs, df, vectors)
    assert measure == "cosine" and {(r["a"], r["b"]): round(r["similarity"], 3) for r in found.collect()} == {(1, 2): 0.707, (3, 3): 1.0}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pruned_pairs_like_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(cluster, "BLOCK", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 12))
    v = np.concatenate([centres[rng.integers(0, 8, 300)] + 0.15 * rng.normal(size=(300, 12)), np.repeat(centres[:1], 40, axis=0), np.zeros((2, 12))])
    names = [i if kind == "long" else f"v{i:04}" for i in range(len(v))]
    df = spark.createDataFrame([(n, [float(x) for x in row]) for n, row in zip(names, v, strict=True)] + [(10_000 if kind == "long" else "x", [1.0])], f"id {kind}, vector array<double>")
    unit = v[:340] / np.linalg.norm(v[:340], axis=1)[:, None]
    s = unit @ unit.T
    for threshold in (0.97, 0.9, 0.2):
        want = {(names[i], names[j]) for i, j in zip(*np.nonzero(s >= threshold), strict=True) if i < j}
        got = [(r["a"], r["b"]) for r in cluster.similar_pairs(df, threshold).collect()]
        assert len(got) == len(want) and set(got) == want
    compared, every = cluster.compared_blocks(df, 0.97)
    assert compared < 0.4 * every
    assert cluster.similar_pairs(df.limit(0), 0.9).count() == 0 and cluster.compared_blocks(df.limit(0), 0.9) == (0, 0)


def test_no_vector_is_sent_for_a_pair(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(rng.normal(size=(60, 6)))], "id long, vector array<double>")
    plan = cluster.similar_pairs(df, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan


@pytest.mark.parametrize("kind", ["long", "string"])
def test_links_connect_what_pairs_connect(spark, monkeypatch, tmp_path, kind):
    monkeypatch.setattr(cluster, "BLOCK", 16)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 12))
    v = np.concatenate([centres[rng.integers(0, 6, 200)] + 0.2 * rng.normal(size=(200, 12)), rng.normal(size=(60, 12))])
    df = spark.createDataFrame([(i if kind == "long" else f"v{i:03}", [float(x) for x in row]) for i, row in enumerate(v)], f"id {kind}, vector array<double>")
    pairs, links = cluster.similar_pairs(df, 0.9), cluster.similar_links(df, 0.9)
    of = lambda edges, name: {tuple(r) for r in cluster.connected(edges, str(tmp_path / name)).collect()}
    assert of(links, "links") == of(pairs, "pairs")
    assert links.count() < 0.5 * pairs.count()


@pytest.mark.parametrize("kind", [int, str])
def test_consolidation_of_any_id(spark, kind):
    name = (lambda i: i) if kind is int else (lambda i: f"u-{i}")
    rows = [memory(name(1), "x", "one", confidence="verified", tags=["b"]), memory(name(2), "x", "two", type="bug", confidence="verified", tags=["a"]), memory(name(3), "x", "three", type="bug", confidence="inferred"), memory(name(4), "y", "alone")]
    df = spark.createDataFrame(rows, COLUMNS if kind is int else COLUMNS.replace("id long", "id string"))
    assert cluster.consolidated(df, "title", "deduplicate").first()["kept"] == name(1)
    m = cluster.consolidated(df, "title", "merge").first()
    assert (m["type"], m["confidence"], m["tags"], m["n"]) == ("bug", "verified", ["b", "a"], 3)
    assert cluster.consolidated(df, "title", "summarize").first()["title"] == "[summarize] x"


def test_consolidation_on_the_declared_schema(spark):
    df = spark.createDataFrame([(i, "n", "fact", "t", "c", "inferred", None, None, None, None, None, 0, None, False, ["x"]) for i in ("u-2", "u-1")], S.MEMORIES)
    assert cluster.consolidated(df, "title", "deduplicate").first()["kept"] == "u-1"
    assert cluster.consolidated(df, F.concat_ws("|", "namespace", "title"), "merge").first()["content"] == "## t\nc\n\n## t\nc"
