"""Namespaces, repairs, hints and transitions on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F
from test_operators import COLUMNS, EDGES, ids, memory

from lorekeep.functions import text
from lorekeep.operators import claims, cluster, filters, graph, hints, listing, namespaces, postings, review, search, state
from lorekeep.plans import evaluate

NOW = "2024-06-01 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS)


def test_namespaces(spark):
    assert namespaces.resolved(" x ", {}, "N", "P") == "x" and namespaces.resolved(None, {"N": "env"}, "N", "P") == "env"
    assert namespaces.resolved("", {"P": "/home/me/project/"}, "N", "P") == "project" and namespaces.resolved(None, {}, "N", "P") == "default"
    given = spark.createDataFrame([("a", None), ("b", "r"), ("default", None)], "name string, default_repo string")
    assert [r["name"] for r in namespaces.for_reading(given, ["b", "a", "b"]).collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="x, y"):
        namespaces.for_reading(given, ["y", "a", "x"])
    more = namespaces.with_names(given, spark.createDataFrame([("a",), ("c",), ("c",), ("",), (None,)], "name string"))
    assert sorted(r["name"] for r in more.collect()) == ["a", "b", "c", "default"]
    new, moved = namespaces.updated(given, spark.createDataFrame([("a", "q"), ("b", "r"), ("zz", "q")], "name string, default_repo string"))
    assert {r["name"]: r["default_repo"] for r in new.collect()} == {"a": "q", "b": "r", "default": None} and [r["name"] for r in moved.collect()] == ["a"]
    df = frame(spark, memory(1, namespace="a"), memory(2, namespace="b"))
    names = spark.createDataFrame([("a",), ("default",), ("zz",)], "name string")
    assert {r["name"]: r["outcome"] for r in namespaces.outcome_of(given, df, names).collect()} == {"a": "not_empty", "default": "protected", "zz": "not_found"}
    spaces, left = namespaces.deleted(given, df, names, cascade=True)
    assert ids(left) == [2] and sorted(r["name"] for r in spaces.collect()) == ["b", "default"]


def test_hints(spark):
    words = "alpha beta gamma delta epsilon"
    df = frame(spark, *[memory(i, words, words + f" w{i}", namespace="a") for i in range(1, 6)], memory(9, "other", "nothing alike", namespace="a"), memory(8, words, words, namespace="b"))
    assert ids(hints.find_similar(df, "a", words, now())) == [1, 2, 3] and hints.find_similar(df, "a", "  ", now()).count() == 0
    edges = spark.createDataFrame([(1, 1, 2, "related_to")], EDGES)
    assert ids(hints.suggest_relations(df, edges, "a", words, now(), 1, [3])) == [4, 5]


def test_index_like_the_scan(spark, tmp_path):
    df = frame(spark, memory(1, "running fast", "run run"), memory(2, "runner", "walks"), memory(3, "", "run"), memory(4, "x", ""))
    for stemmed in (False, True):
        path = f"{tmp_path}/{stemmed}"
        postings.write(df, path, stemmed)
        for query in ("run", "running walks run", "absent"):
            got, want = ({r["id"]: round(r["bm25"], 9) for r in x.collect()} for x in (postings.bm25(spark, path, query, stemmed), search.bm25(df, query, stemmed)))
            assert got == want and (query == "absent") == (not want)


def test_guards_and_fallback(spark, tmp_path):
    df = frame(spark, memory(1, "t"), memory(2, "t"), memory(3, namespace="b"))
    assert sorted(ids(cluster.for_consolidation(df, [1, 2, 2], "merge"))) == [1, 2]
    for bad in (([1, 2], "nonsense"), ([1, 1], "merge"), ([1, 7], "merge"), ([1, 3], "merge")):
        with pytest.raises(ValueError):
            cluster.for_consolidation(df, *bad)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01])], "id long, vector array<double>")
    assert cluster.clusters_or_titles(df, vectors, str(tmp_path / "a"), 0.9)[0] == "vectors"
    assert cluster.clusters_or_titles(df, vectors, str(tmp_path / "b"), 1.0)[0] == "titles" == cluster.clusters_or_titles(df, vectors.limit(0), str(tmp_path / "c"), 0.9)[0]


def test_transitions(spark):
    df = frame(spark, memory(1, tags=["x"]), memory(2))
    fresh = spark.createDataFrame([(5, "a", "fact", "new", "text", "verified", [" A b", "a-b"])], "id long, namespace string, type string, title string, content string, confidence string, tags array<string>")
    row = state.created(df, fresh, now()).where("id = 5").first()
    assert row["last_confirmed"] is not None and row["tags"] == ["a-b"] and not row["pinned"] and row["access_count"] == 0
    assert str(state.touched(df, df.where("id = 2"), now()).where("id = 2").first()["last_accessed"]) == NOW
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id long, v string, version int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 0)], "id long, v string, version int")
    assert {r["id"]: r["v"] for r in state.upserted(old, new, "id", "version").collect()} == {1: "c", 2: "b", 3: "e"}
    edges = cluster.retired(spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id long, kept long"))
    assert sorted((r["source_id"], r["target_id"]) for r in edges.collect()) == [(1, 2), (1, 3)]
    have = spark.createDataFrame([(1, [1.0, 2.0]), (7, [1.0])], "id long, vector array<double>")
    encode = lambda texts: [[float(len(t)), 0.0] if "c" in t else None for t in texts]
    assert {r["id"]: r["vector"] for r in state.embedded(df, have, encode, 2, 10).collect()} == {1: [1.0, 2.0], 2: [4.0, 0.0], 7: [1.0]}
    known = namespaces.tag_table(spark.createDataFrame([("x",), ("gone",)], "tag string"), namespaces.tags_of(df))
    assert [r["tag"] for r in known.collect()] == ["x"]


def test_texts_and_vectors(spark):
    df = spark.createDataFrame([("T", "body", [1.5, -2.0]), (None, None, None)], "title string, content string, vector array<float>")
    rows = df.select(text.embedding_input(F.col("title"), F.col("content")).alias("t"), text.unpacked_vector(text.packed_vector("vector")).alias("v")).collect()
    assert [(r["t"], r["v"]) for r in rows] == [("T\n\nbody", [1.5, -2.0]), ("\n\n", None)]


def test_quoted_signals_do_not_count(spark):
    texts = {
        "it expires 2024-01-10": "expired-date", 'the text "expires 2024-01-10" is quoted': "", "`expires 2024-01-10": "expired-date", 'a "b" expires on 2024-01-10 "c"': "", "expires 2024-13-40": "",
        "waiting on Joe": "waiting-on", "waiting on it": "", '"waiting on Joe"': "", "was waiting on Joe": "", "PR #5 is still open": "open-pr-reference", "branch x is not yet merged": "unmerged-branch", "as of 2024-01-01 true": "stale-as-of-date",
    }
    df = frame(spark, *[memory(i, content=t, created="2024-01-01") for i, t in enumerate(texts)])
    got = {r["content"]: ",".join(r["signals"]) for r in review.with_signals(df, now()).collect()}
    assert got == texts


def test_claims_are_resolved(spark):
    df = spark.createDataFrame([("r#1", "open", None), ("r#2", "unverified", None), ("r#3", "open", "resolved")], "ref string, state string, resolved_state string")
    assert [r["resolved_state"] for r in claims.resolve(df, "all").orderBy("ref").collect()] == ["resolved", None, "resolved"]
    assert [r["resolved_state"] for r in claims.resolve(df, ["r#2"]).orderBy("ref").collect()] == [None, "resolved", "resolved"]
    with pytest.raises(ValueError):
        claims.in_mode(df, df, "nonsense")


def test_golden_set(spark, tmp_path):
    keys = {"harbour": "ships wait at the harbour wall for the tide", "bread": "bread rises slowly in a cold kitchen", "tide": "the tide table lists high water by day"}
    data = {"memories": [{"key": k, "namespace": "n", "type": "fact", "title": k, "content": c} for k, c in keys.items()], "questions": [{"id": "q1", "query": "slow bread", "relevant": ["bread"]}, {"id": "q2", "query": "high water table", "relevant": ["tide"]}]}
    path = tmp_path / "golden.json"
    path.write_text(json.dumps(data))
    held, questions, relevant = evaluate.golden_set(spark, str(path))
    ranking = search.batch_bm25(held.withColumnRenamed("key", "id"), questions.select(F.col("id").alias("question"), "query"), 5)
    assert evaluate.summary(evaluate.scored(ranking, relevant, (1, 5))).first()["recall_5"] > 0.5
    data["questions"][0]["relevant"] = ["nowhere"]
    path.write_text(json.dumps(data))
    with pytest.raises(ValueError):
        evaluate.golden_set(spark, str(path))


def test_claim_backlog_and_composed_filter(spark):
    df = frame(spark, memory(1, "a", "PR #1 open", created="2024-01-03"), memory(2, "b", "PR #1 merged"), memory(3, "c", "PR #3 open", created="2024-01-01"), memory(4, "d", "PR #4 open", confidence="deprecated"), memory(5, "e", "PR #5 open", created="2024-01-02"), memory(6, "f", "PR #6"))
    found = claims.extract(df, F.col("namespace")).withColumn("resolved_state", F.when(F.col("memory_id") == 5, "resolved"))
    assert claims.statistics(found, df).first().asDict() == {"open": 3, "resolved": 1, "unverified": 1, "open_actionable": 2, "contradicted": 1}
    assert [(r["id"], r["contradicted"]) for r in claims.sample(found, df).collect()] == [(1, True), (3, False)]
    assert [r["id"] for r in claims.sample(found, df, 0).collect()] == [1]
    edges = spark.createDataFrame([(1, 1, 2, "related_to")], EDGES)
    assert ids(filters.select_memories(df, claims=(found, "open"))) == [1, 3]
    assert ids(filters.select_memories(df, claims=(found, "open"), orphans_of=edges)) == [3]
    assert ids(filters.select_memories(df, include_deprecated=True, claims=(found, "open"), orphans_of=edges)) == [3, 4]
    assert ids(filters.select_memories(df, claims=(found, "contradicted"))) == [1] and ids(filters.select_memories(df, claims=(found, "unverified"))) == [6]
    total, rows = listing.page(df, [F.col("id")], 4, 10)
    assert total == 6 and ids(rows) == [5, 6]
    assert listing.page(df, [F.col("id")], 40, 10)[0] == 6
