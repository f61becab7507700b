"""Operators on small fixtures with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lorekeep import registry
from lorekeep import schema as S
from lorekeep.functions import scoring, text
from lorekeep.operators import claims, cluster, context, filters, graph, promote, review, search, state, stats
from lorekeep.plans import evaluate
from lorekeep.sources import portability
from lorekeep.streaming import access

NOW = None


@pytest.fixture(autouse=True)
def _now(spark):
    global NOW
    NOW = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")


def memory(id, title="t", content="c", namespace="a", type="fact", confidence="inferred", created="2024-05-01", confirmed=None, accessed="2024-05-01", count=0, pinned=False, tags=()):
    day = lambda x: dt.datetime.fromisoformat(x) if x else None
    return (id, namespace, type, title, content, confidence, day(created), day(created), day(accessed), day(confirmed), count, pinned, list(tags))


COLUMNS = "id long, namespace string, type string, title string, content string, confidence string, created_at timestamp_ntz, updated_at timestamp_ntz, last_accessed timestamp_ntz, last_confirmed timestamp_ntz, access_count long, pinned boolean, tags array<string>"
EDGES = "edge_id long, source_id long, target_id long, relation_type string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_relative_age(spark):
    cases = {
        "2024-06-01 11:59:00": "just now", "2024-06-01 11:15:00": "45 minutes ago", "2024-06-01 11:00:00": "1 hour ago", "2024-05-31 11:00:00": "1 day ago",
        "2024-05-26 12:00:00": "6 days ago", "2024-05-25 12:00:00": "1 week ago", "2024-03-01 12:00:00": "3 months ago", "2022-05-01 12:00:00": "2 years ago", "2025-01-01 00:00:00": "just now",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    for r in df.select("want", scoring.relative_age(F.col("t").cast("timestamp_ntz"), NOW).alias("got")).collect():
        assert r["got"] == r["want"]


def test_weights():
    assert scoring.normalised_weights() == S.WEIGHTS
    assert scoring.normalised_weights({"relevance": 2, "freshness": -1, "access": 0, "confidence": 2}) == {"relevance": 0.5, "freshness": 0.0, "access": 0.0, "confidence": 0.5}
    assert scoring.normalised_weights({k: 0 for k in S.WEIGHTS}) == S.WEIGHTS


def test_text_functions(spark):
    df = spark.createDataFrame([("Été à la PLAGE, a bc déf_1", "  My  Tag\tx ", "word " * 60)], "t string, tag string, long string")
    r = df.select(text.tokens(F.col("t")).alias("a"), text.normalised_tag(F.col("tag")).alias("b"), text.excerpt(F.col("long")).alias("c"), F.lit(0)).first()
    assert r["a"] == ["été", "plage", "déf_1"]
    assert r["b"] == "my-tag-x"
    assert len(r["c"]) <= 202 and r["c"].endswith("word …")
    assert [text.porter(w) for w in ("concurrently", "running")] == ["concurr", "run"]
    assert text.csv_list(" a, ,b ,") == ["a", "b"]
    one = spark.createDataFrame([('{"b": 1, "a": 2}',), ("[1]",), ("nonsense",), (None,)], "m string").select(text.sorted_metadata("m").alias("m")).collect()
    assert [r["m"] for r in one] == ['{"a": 2, "b": 1}', None, None, None]


def test_filters_come_before_limits(spark):
    from lorekeep.operators.listing import by_score

    rows = [memory(i, confidence="inferred") for i in range(10)] + [memory(99, confidence="verified")]
    assert ids(by_score(filters.select_memories(frame(spark, *rows), min_confidence="verified"), 1, NOW)) == [99]
    df = frame(spark, memory(1, tags=["x", "y"]), memory(2, tags=["x"]), memory(3, tags=None or []), memory(4, confidence="deprecated", tags=["x", "y"]))
    assert ids(filters.select_memories(df, tags=["X", " y", "x"])) == [1]
    assert sorted(ids(filters.select_memories(df, include_deprecated=True))) == [1, 2, 3, 4]


def test_stemmed_search(spark):
    df = frame(spark, memory(1, "Python async patterns", "Use concurrent tasks"), memory(2, "SQLite locking", "writers wait"))
    assert ids(search.bm25(df, "concurrently", stemmed=True)) == [1]
    assert ids(search.bm25(df, "concurrently")) == []
    assert ids(search.bm25(df, "?!")) == []


def test_hybrid_lets_vectors_in_and_is_a_prefix(spark):
    df = frame(spark, *[memory(i, "alpha" if i % 2 else "beta", "alpha " * (i % 5)) for i in range(60)])
    vectors = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(0, 60, 3)], "id long, vector array<double>")
    deep = ids(search.hybrid(df, df, vectors, "alpha", [1.0, 0.0], NOW, 30))
    assert ids(search.hybrid(df, df, vectors, "alpha", [1.0, 0.0], NOW, 5)) == deep[:5]
    only = search.fused(df, df, vectors.where("id = 0"), "gamma", [1.0, 0.0], 5)
    assert ids(only) == [0]
    plain = search.fused(df, df, None, "alpha", None, 5).orderBy(F.desc("relevance")).first()
    assert plain["relevance"] == 1.0


def test_graph(spark):
    df = frame(spark, *[memory(i, confidence="verified" if i == 3 else "inferred") for i in range(8)])
    edges = spark.createDataFrame([(i, 0, i, "parent_of") for i in range(1, 6)] + [(9, 1, 6, "related_to"), (10, 1, 6, "caused_by"), (11, 6, 1, "related_to")], EDGES)
    m = graph.metrics(df, edges).first()
    assert (m["edges"], m["orphans"], m["over_cap"], m["high_signal"]) == (8, 1, 2, 6)
    assert ids(filters.orphans(df, edges)) == [7]
    assert graph.neighbours(df, edges, [0, 1]) == [3, 5, 4, 6]
    assert graph.neighbours(df, edges, [0], total=2) == [3, 5]
    out = {r["edge_id"]: r["outcome"] for r in graph.retyped(edges, "caused_by", "related_to").collect()}
    assert out[10] == "merged" and out[9] == "unchanged"
    assert {r["outcome"] for r in graph.reversed_edges(edges, "related_to").collect()} == {"merged"}
    assert graph.induced(edges, df.where("id < 3")).count() == 2


def test_shared_tags(spark):
    df = frame(spark, memory(1, tags=["a", "b", "c"]), memory(2, tags=["a", "b"]), memory(3, tags=["a"]), memory(4, tags=["c", "b", "a"]))
    got = {(r["a"], r["b"]): r["shared"] for r in graph.shared_tag_links(df).collect()}
    assert got == {(1, 2): 2, (1, 4): 3, (2, 4): 2}


def test_shared_tags_of_all_rows(spark, sf):
    df = frame(spark, memory(1, tags=["a", "b"]), memory(2, tags=["b", "a", "a"]), memory(3, tags=["b", "a"]), memory(4, tags=["a", "b", "c"]), memory(5, tags=["c"]), memory(6), memory(7, tags=["b", "c", "d"]))
    classes = graph.tag_classes(df)
    assert {r["id"]: r["class"] for r in classes.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
    links = {(r["a"], r["b"]): (r["shared"], r["pairs"]) for r in graph.class_links(classes).collect()}
    assert links == {(1, 1): (2, 3), (1, 4): (2, 3), (4, 7): (2, 1)}
    every = {(r["a"], r["b"]): r["shared"] for r in graph.shared_tag_links(df).collect()}
    assert every == {(1, 2): 2, (1, 3): 2, (2, 3): 2, (1, 4): 2, (2, 4): 2, (3, 4): 2, (4, 7): 2}
    assert {(r["a"], r["b"]) for r in graph.shared_tag_links(df, 1).collect()} == set(every) | {(1, 7), (2, 7), (3, 7), (4, 5), (5, 7)}
    found = registry.QUERIES["shared_tag_classes"](spark, sf)
    assert found.where("kind = 'member'").count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_clusters(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.98, 0.2]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0])], "id long, vector array<double>")
    pairs = cluster.similar_pairs(v, 0.85)
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [(1, 2)]
    assert cluster.similar_pairs(v, 0.999).count() == 0
    one = cluster.duplicate_clusters(pairs, str(tmp_path)).first()
    assert one["members"] == [1, 2] and one["peak"] == 0.98
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "a long, b long")
    got = {r["id"]: r["cluster"] for r in cluster.connected(chain, str(tmp_path / "x")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[51] == 50


def test_consolidation(spark):
    df = frame(spark, memory(1, "x", "one", confidence="inferred", tags=["b"]), memory(2, "x", "two", type="bug", confidence="verified", tags=["a", "b"]), memory(3, "y", "three"))
    m = cluster.consolidated(df, "title", "merge").first()
    assert m["content"] == "## x\none\n\n## x\ntwo" and m["title"] == "[merge] x" and m["confidence"] == "verified" and m["tags"] == ["b", "a"] and m["type"] == "fact"
    assert cluster.consolidated(df, "title", "deduplicate").first()["kept"] == 2
    with pytest.raises(ValueError):
        cluster.consolidated(df, "title", "shred")


CLAIMS = [
    ("PR #12 merged", [("pr", "repo#12", "resolved")]),
    ("PR #10, open, NOT merged yet", [("pr", "repo#10", "open")]),
    ('the doc said "PR #3 merged"', []),
    ("see [[PR #4 merged]]", []),
    ("MR !7 is held", [("mr", "repo#7", "open")]),
    ("https://github.com/x/tool/pull/8 PR #8", [("pr", "tool#8", "unverified")]),
    ("PR #5\nPR #5 merged", [("pr", "repo#5", "resolved")]),
    ("no reference at all", []),
]


@pytest.mark.parametrize("content,want", CLAIMS)
def test_claims(content, want):
    assert [(c["kind"], c["ref"], c["state"]) for c in claims.claims_in(content, "repo", {})] == want


def test_contradiction(spark):
    df = frame(spark, memory(1, content="PR #1 open"), memory(2, content="PR #1 merged"), memory(3, content="PR #1 open", namespace="b"), memory(4, content="PR #2 open"))
    found = claims.extract(df, claims.default_repo(F.col("namespace"), F.lit(None).cast("string")))
    assert [r["memory_id"] for r in claims.contradicted(found, df.select("id")).collect()] == [1]
    assert claims.contradicted(found, df.where("id <> 2").select("id")).count() == 0
    old = found.where("memory_id IN (1, 2)").withColumn("resolved_state", F.lit("done"))
    new = found.where("memory_id IN (2, 4)").withColumn("state", F.when(F.col("memory_id") == 2, "open").otherwise(F.col("state")))
    assert {r["memory_id"]: r["change"] for r in claims.rederived(old, new).collect()} == {1: "pruned", 2: "changed", 4: "added"}


def test_review(spark):
    rows = [
        memory(1, content="token expires 2024-05-20"), memory(2, content="expires 2024-01-01; renewed: expires 2030-01-01"), memory(3, content='a bug quoting "expires 2024-01-01" here'),
        memory(4, content="as of 2024-05-01 nothing"), memory(5, content="waiting for EOF"), memory(6, content="waiting on Joe"), memory(7, content="waiting on Joe", type="pattern"),
        memory(8, content="expires 2024-05-20", confirmed="2024-05-25"), memory(9, content="PR #3 still open"), memory(10, content=None),
    ]
    got = {r["id"]: r["signals"] for r in review.with_signals(frame(spark, *rows), NOW).collect()}
    assert got == {1: ["expired-date"], 2: [], 3: [], 4: ["stale-as-of-date"], 5: [], 6: ["waiting-on"], 7: [], 8: [], 9: ["open-pr-reference"], 10: []}


def test_promotion(spark):
    df = frame(spark, memory(1, confidence="verified"), memory(2, confidence="verified", content="sk-abcdefgh12345"), memory(3, confidence="verified", tags=["Journal"]), memory(4))
    assert ids(df.where(promote.promotable())) == [1]
    done = promote.promoted(df, df.limit(0).withColumn("metadata", F.lit("")), "here", "me", "2024-01-01")
    assert ids(done) == [1]
    assert promote.promoted(df, done, "here", "me", "2024-01-01").count() == 0
    assert promote.promoted_ids(spark.createDataFrame([("not json",), (None,)], "metadata string")).count() == 0


def test_export_and_import(spark, tmp_path):
    df = frame(spark, memory(1), memory(2), memory(3, namespace="b"))
    edges = spark.createDataFrame([(1, 1, 2, "related_to"), (2, 1, 3, "related_to")], EDGES)
    own, inner = portability.export_rows(df, edges, "a")
    assert inner.count() == 1
    portability.export_lines(own, inner, str(tmp_path))
    m, r = portability.read_lines(spark, str(tmp_path), own.schema, inner.schema)
    changed = m.withColumn("title", F.lit("new"))
    every, linked = portability.imported(df, edges, changed, r, "skip")
    assert every.where("title = 'new'").count() == 0 and linked.count() == 2
    every, linked = portability.imported(df, edges, changed, r, "replace")
    assert sorted(ids(every.where("title = 'new'"))) == [1, 2] and linked.count() == 1
    with pytest.raises(ValueError):
        portability.imported(df, edges, changed.withColumn("type", F.lit("odd")), r)
    import json

    document = json.loads(portability.export_document(own, inner, "2024-01-01").first()["export"])
    assert document["format_version"] == 1 and len(document["memories"]) == 2


def test_state(spark):
    df = frame(spark, memory(1, confirmed="2024-05-01"), memory(2))
    patch = spark.createDataFrame([(1, "other", None)], "id long, title string, confidence string")
    one = state.updated(df, patch, NOW).where("id = 1").first()
    assert one["title"] == "other" and one["last_confirmed"] == dt.datetime(2024, 6, 1, 12)
    gone = spark.createDataFrame([(2,)], "id long")
    assert state.forgotten(df, gone).where("confidence = 'deprecated'").count() == 1
    edges = spark.createDataFrame([(1, 1, 2, "related_to")], EDGES)
    left, rest, _ = state.deleted(df, edges, {}, gone)
    assert ids(left) == [1] and rest.count() == 0
    tags = spark.createDataFrame([(1, ["A b", "a-b", "c"])], "id long, tags array<string>")
    assert state.tagged(df, tags).where("id = 1").first()["tags"] == ["a-b", "c"]
    same = spark.createDataFrame([(7, 1, 2, "related_to"), (8, 1, 1, "related_to"), (9, 2, 1, "caused_by")], EDGES)
    assert state.related(edges, same).count() == 2


def test_context(spark):
    rows = [memory(i, accessed=f"2024-05-{i + 1:02d}", pinned=i == 5) for i in range(20)] + [memory(50, namespace="b", type="pattern", confidence="verified", count=3)]
    got = context.selected(frame(spark, *rows), "a", NOW, limit=6).orderBy("position").collect()
    assert [r["id"] for r in got][:4] == [5, 19, 18, 50]
    assert len(got) == 7 and [r["bucket"] for r in got].count("backfill") == 3


def test_measures(spark):
    ranking = spark.createDataFrame([("q", 1, 7), ("q", 2, 8), ("r", 1, 1)], "question string, rank int, id long")
    relevant = spark.createDataFrame([("q", 8), ("q", 9), ("s", 1)], "question string, id long")
    got = {r["question"]: r for r in evaluate.scored(ranking, relevant, (1, 5)).collect()}
    assert got["q"]["recall_5"] == 0.5 and got["q"]["reciprocal_rank"] == 0.5 and got["q"]["precision_1"] == 0.0 and got["s"]["recall_1"] == 0.0


def test_expiry(spark):
    df = spark.createDataFrame([("a", "2024-05-01"), ("b", "2024-06-10"), ("c", "2025-01-01")], "service string, t string").withColumn("expires_at", F.col("t").cast("timestamp_ntz"))
    r = stats.expiry(df, NOW).first()
    assert (r["total"], r["expired"], r["expiring_soon"]) == (3, 1, 1)


def test_stream(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i % 5, 30), "click") for i in range(50)]
    spark.createDataFrame(rows, "memory_id long, accessed_at timestamp, context string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("memory_id long, accessed_at timestamp, context string").parquet(str(tmp_path / "in"))
    access.started(access.windowed_accesses(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sum(r["n"] for r in got) == 40  # the last hour is still open
