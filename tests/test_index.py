"""The keyword index: scores like the scan's, skipped blocks, upkeep over segments."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import COLUMNS, memory

from lorekeep import schema as S
from lorekeep.operators import filters, hints, postings, search
from lorekeep.sources import views

WORDS = [f"w{i}" for i in range(40)]
NOW = "2024-06-01 12:00:00"


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(postings, "BUCKETS", 4)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def corpus(spark, rng, ids, longest=60):
    texts = [" ".join(rng.choices(WORDS, [1 / (1 + i) for i in range(40)], k=rng.randint(0, longest))) for _ in ids]
    return spark.createDataFrame([(i, "t" if n % 3 else None, t) for n, (i, t) in enumerate(zip(ids, texts, strict=True))], f"id {'string' if isinstance(ids[0], str) else 'long'}, title string, content string")


def scores(df):
    return {r["id"]: round(r["bm25"], 9) for r in df.collect()}


@pytest.mark.parametrize("kind", [str, int])
def test_after_any_changes_scores_are_those_of_a_fresh_index(spark, tmp_path, kind):
    rng, path = random.Random(5), str(tmp_path / "index")
    now_held = {kind(i): r for i, r in enumerate(corpus(spark, rng, [kind(i) for i in range(60)]).collect())}
    as_frame = lambda rows: spark.createDataFrame([tuple(r) for r in rows], f"id {'string' if kind is str else 'long'}, title string, content string")
    postings.write(as_frame(now_held.values()), path)
    for round_ in range(2):
        gone = rng.sample(sorted(now_held), 8)
        fresh = [kind(100 * (round_ + 1) + i) for i in range(4)] + gone[:4] + ([kind(100)] if round_ == 1 and kind(100) not in now_held else [])
        removed = [now_held.pop(i) for i in gone]
        added = corpus(spark, rng, fresh).collect()
        index = postings.changed(spark, path, as_frame(removed), as_frame(added))
        now_held |= {r["id"]: r for r in added}
    every = as_frame(now_held.values())
    for query in ("w0 w3 w17", "w39 w2 w2") if kind is int else ("w0 w3 w17", "nothing", ""):
        want = scores(search.bm25(every, query))
        assert scores(index.bm25(query)) == want
        best = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:7]
        assert [(r["id"], round(r["bm25"], 9)) for r in index.top(query, 7).collect()] == best
    full = postings.compacted(spark, path)
    assert (full.n, full.length, len(full.segments)) == (len(now_held), index.length, 1)
    assert scores(full.bm25("w0 w3 w17")) == scores(search.bm25(every, "w0 w3 w17"))
    assert full.changes is False and scores(postings.bm25(spark, path, "w5")) == scores(search.bm25(every, "w5"))


def test_blocks_that_cannot_win_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "DOCUMENTS", 4)
    monkeypatch.setattr(postings, "FIRST", 4)
    rng = random.Random(7)
    df = corpus(spark, rng, list(range(400)), 80).cache()
    index = postings.write(df, str(tmp_path / "index"))
    for query in ("w0 w25", "w30 w31 w32"):
        want = sorted(scores(search.bm25(df, query)).items(), key=lambda x: (-x[1], x[0]))
        assert [(r["id"], round(r["bm25"], 9)) for r in index.top(query, 5).collect()] == want[:5]
        kept = df.where("id % 3 = 0").select("id")
        assert [(r["id"], round(r["bm25"], 9)) for r in index.top(query, 5, kept).collect()] == [x for x in want if x[0] % 3 == 0][:5]
    every, read = index.pruning("w30 w31 w32", 5)
    assert read < 0.6 * every


def test_search_and_hints_take_an_index(spark, tmp_path):
    rows = [memory(i, title=f"note {i}", content=" ".join(["sail"] * (i % 5 + 1) + ["wind", f"x{i % 7}"] * (i % 3)), namespace="ab"[i % 2]) for i in range(1, 60)]
    df = spark.createDataFrame(rows, COLUMNS)
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 7)]) for i in range(1, 60)], "id long, vector array<double>")
    index = postings.write(df, str(tmp_path / "index"))
    kept = filters.select_memories(df, ["a"])
    for limit, weights in ((1, None), (50, S.WEIGHTS)):
        one, other = (search.hybrid(df, kept, vectors, "sail x3 wind", [1.0, 0.0, 2.0], now(), limit, weights, 0.5, index=i).select("id", F.round("score", 9)).collect() for i in (None, index))
        assert one == other and len(one) <= limit
    shallow, deep = ([r["id"] for r in search.hybrid(df, kept, None, "sail", None, now(), k, index=index).collect()] for k in (3, 9))
    assert deep[:3] == shallow
    for order in ("relevance", "accessed", "created"):
        one, other = ([r["id"] for r in search.dispatched(df, kept, now(), "sail x3", order, 6, index=i).collect()] for i in (None, index))
        assert one == other
    one, other = ([tuple(r) for r in hints.find_similar(df, "a", "sail wind x1", now(), index=i).select("id", "similarity").collect()] for i in (None, index))
    assert one == other and one
    assert search.hybrid(df, kept, None, " .. ", None, now(), 5, index=index).count() == 0


def test_stems_are_the_index_s_choice(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "connected connections"), (2, "b", "connecting it"), (3, "c", "nothing here")], "id long, title string, content string")
    index = postings.write(df, str(tmp_path / "index"), stemmed=True)
    assert scores(index.bm25("connection")) == scores(search.bm25(df, "connection", stemmed=True))
    with pytest.raises(ValueError, match="stems"):
        postings.bm25(spark, str(tmp_path / "index"), "connection")


def test_empty_index(spark, tmp_path):
    index = postings.write(spark.createDataFrame([], "id string, title string, content string"), str(tmp_path / "index"))
    assert index.n == 0 and index.bm25("x").count() == 0 and index.top("x", 3).count() == 0
    index = postings.changed(spark, str(tmp_path / "index"), index.bm25("x").selectExpr("id", "'' AS title", "'' AS content"), spark.createDataFrame([("a", "x", "y")], "id string, title string, content string"))
    assert [r["id"] for r in index.top("x", 3).collect()] == ["a"]


def test_postings_are_packed_before_anything_is_sent(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "DOCUMENTS", 16)
    df = corpus(spark, random.Random(3), list(range(200)), 30).repartition(2).cache()
    plan = postings.packed(df, False)._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan
    index = postings.write(df, str(tmp_path / "index"))
    assert index.postings().count() < 0.5 * sum(len(set(r["content"].split())) for r in df.collect())


def test_compaction_joins_short_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "DOCUMENTS", 8)
    df, path = corpus(spark, random.Random(4), list(range(96)), 20).coalesce(1).cache(), str(tmp_path / "index")
    postings.write(df.where("id < 48"), path)
    postings.changed(spark, path, df.where("id < 36"), df.where("id >= 48 AND id < 52"))
    index = postings.changed(spark, path, df.limit(0), df.where("id >= 52 AND id < 56"))
    left = df.where("id >= 36 AND id < 56")
    full = postings.compacted(spark, path)
    assert full.blocks().count() <= index.blocks().count() - 3
    assert full.postings().groupBy("term", "block").count().where("count > 1").isEmpty()
    assert scores(full.bm25("w0 w1 w7")) == scores(search.bm25(left, "w0 w1 w7"))


def test_texts_are_those_of_the_memories(spark, sf, tmp_path):
    names = ["id", "namespace", "title", "content"]
    plan = views.texts(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    for name in ("documents", "events"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for held in (labels, labels.union(labels.limit(3))):
        held.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
        want = views.memories(spark, str(tmp_path)).select(names)
        got = views.texts(spark, str(tmp_path))
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()
