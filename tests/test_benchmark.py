"""Many questions at once like one by one, by kind and namespace; the access stream with expiry."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_operators import COLUMNS, memory

from lorekeep import schema as S
from lorekeep.operators import filters, search
from lorekeep.plans import benchmark, evaluate
from lorekeep.streaming import access

# Our own golden set: two namespaces with near misses in the other one.
MEMORIES = [
    ("m1", "kitchen", "Bread proofing", "Dough proofs two hours at 26 degrees, longer in winter"), ("m2", "kitchen", "Knife sharpening", "Whetstone of grit 1000 then 3000, fifteen degrees"),
    ("m3", "kitchen", "Oven hot spot", "The back left corner of the oven burns pastry"), ("m4", "kitchen", "Stock freezing", "Freeze stock flat in bags, label with the date"),
    ("m5", "kitchen", "Sourdough feeding", "Feed the starter with rye at one to five"), ("m6", "kitchen", "Pan seasoning", "Season the carbon steel pan with flax oil"),
    ("m7", "kitchen", "Pickle brine", "Five percent salt for cucumbers"), ("m8", "garden", "Tomato pruning", "Remove suckers below the first truss"),
    ("m9", "garden", "Compost ratio", "Three parts brown to one part green"), ("m10", "garden", "Rye as cover crop", "Sow rye in autumn and cut it in spring"),
    ("m11", "garden", "Watering hours", "Water at dawn, two hours for the long bed"), ("m12", "garden", "Knife for grafting", "Keep the grafting knife at a shallow bevel"),
    ("m13", "garden", "Frost cloth", "Cover the beds below two degrees"), ("m14", "garden", "Salt and slugs", "No salt in the beds, use copper tape"),
]
QUESTIONS = [
    ("q1", "how long does dough proof", ["kitchen"], ["m1"], "lookup"), ("q2", "sharpening a knife on a whetstone", [], ["m2"], "lookup"), ("q3", "which corner of the oven burns", ["kitchen"], ["m3"], "lookup"),
    ("q4", "rye in the starter", ["kitchen"], ["m5"], "near miss"), ("q5", "rye in autumn", [], ["m10"], "near miss"), ("q6", "salt for cucumbers", ["kitchen", "garden"], ["m7"], "near miss"),
    ("q7", "brown and green parts of compost", ["garden"], ["m9"], "lookup"), ("q8", "keeping a knife sharp", [], ["m2", "m12"], "several"),
]


def now():
    return F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")


def test_golden_questions(spark, tmp_path):
    path = str(tmp_path / "golden.json")
    golden = {
        "memories": [{"key": k, "namespace": n, "title": t, "content": c} for k, n, t, c in MEMORIES],
        "questions": [{"id": i, "query": q, "namespaces": n, "relevant": r, "kind": k} for i, q, n, r, k in QUESTIONS],
    }
    with open(path, "w") as f:
        json.dump(golden, f)
    found, asked, relevant = evaluate.golden_set(spark, path)
    rows = [memory(r["key"], r["title"], r["content"], namespace=r["namespace"]) for r in found.collect()]
    df = spark.createDataFrame(rows, COLUMNS.replace("id long", "id string"))
    questions = asked.select(F.col("id").alias("question"), "query", "namespaces", "kind", F.lit(None).cast("array<double>").alias("vector"))
    ranks = benchmark.ranking(df, df, questions, None, now(), 5)
    means = benchmark.by_kind(ranks, relevant, questions, (1, 5))
    told = {r["kind"]: r for r in means.collect()}
    assert set(told) == {"lookup", "near miss", "several", "overall"} and told["overall"]["questions"] == 8
    assert told["overall"]["recall_5"] > 0.5 and told["lookup"]["recall_5"] == 1.0
    lines = benchmark.report(means).splitlines()
    assert lines[0].split() == ["kind", "questions", "recall_1", "recall_5", "precision_1", "precision_5", "reciprocal_rank"] and lines[-1].startswith("overall") and len(lines) == 5
    with pytest.raises(ValueError, match="attic"):
        benchmark.ranking(df, df, questions.withColumn("namespaces", F.array(F.lit("attic"))), None, now())


def test_many_questions_like_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(benchmark, "PORTION", 4)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    rows = [memory(i, " ".join(rng.choices(words, k=2)), " ".join(rng.choices(words, k=8)), namespace="ab"[i % 2], confidence=rng.choice(["verified", "inferred", "deprecated"])) for i in range(150)]
    df = spark.createDataFrame(rows, COLUMNS)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(0, 150, 2)] + [(151, [1.0, 0.0, 0.0]), (1, [1.0])], "id long, vector array<double>").cache()
    asked = [(q, " ".join(rng.choices([*words, "zz"], k=2)) if q else "zz", [[], ["a"], ["b"], ["a", "b"]][q % 4], [1.0, 0.5, -1.0] if q % 3 == 1 else [0.0, 1.0, 0.2] if q % 3 == 0 else None) for q in range(7)]
    questions = spark.createDataFrame(asked, "question long, query string, namespaces array<string>, vector array<double>")
    kept = filters.select_memories(df)
    for weights in (S.WEIGHTS,):
        got = {}
        for r in benchmark.ranking(df, kept, questions, vectors, now(), 7, weights, 0.3).orderBy("question", "rank").collect():
            got.setdefault(r["question"], []).append(r["id"])
        for q, query, spaces, vector in asked:
            own = filters.select_memories(df, spaces or None)
            want = [r["id"] for r in search.hybrid(df, own, vectors, query, vector, now(), 7, weights, 0.3).collect()]
            assert got.get(q, []) == want, q


def test_access_state_expires_and_survives_a_restart(spark, tmp_path):
    rng, start = random.Random(8), datetime(2024, 1, 1)
    rows = sorted((start + timedelta(days=rng.uniform(0, 200)), rng.randrange(12)) for _ in range(600))
    rows = [(m, t) for t, m in rows if not (m == 5 and t > start + timedelta(days=20)) and not (m == 6 and t > start + timedelta(days=150))]
    source, path, checkpoint = (str(tmp_path / x) for x in ("source", "out", "checkpoint"))
    schema = "memory_id long, accessed_at timestamp_ntz"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    for part in range(2):  # the second run goes on from the checkpoint
        own = rows[: len(rows) // 2] if part == 0 else rows[len(rows) // 2 :]
        for i in range(0, len(own), 150):
            spark.createDataFrame(own[i : i + 150], schema).coalesce(1).write.mode("append").parquet(source)
        query = access.kept_counts(stream(), path, checkpoint)
        query.awaitTermination()
        until = rows[: len(rows) // 2] if part == 0 else rows
        watermark = int((max(t for _, t in until) - datetime(1970, 1, 1) - timedelta(minutes=10)).total_seconds() * 1000)
        want = access.retained(spark.createDataFrame(until, schema), watermark)
        assert sorted(map(tuple, access.latest_counts(spark, path).collect())) == sorted(map(tuple, want.collect()))
    left = {r["memory_id"]: r["n"] for r in access.latest_counts(spark, path).collect()}
    assert 5 not in left and 0 < left[6] < sum(m == 6 for m, _ in rows)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pools_are_the_best_of_each_question_without_sending_words(spark, kind):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(25)]
    rows = [(i if kind == "long" else f"m{i:03}", "abc"[i % 3], "t", " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(240)]
    rows += [(500 + i if kind == "long" else f"x{i}", "a", "t", "w1 w2 w3") for i in range(30)]  # ties
    df = spark.createDataFrame(rows, f"id {kind}, namespace string, title string, content string")
    kept = df.where("content <> 'w1 w2 w3' OR namespace = 'a'").where("namespace <> 'c'")
    questions = spark.createDataFrame([(1, "w1 w2 w2 w9", []), (2, "w3 w1", ["a"]), (3, "nothing there", []), (4, "", None), (5, "w7", ["b", "c"])], "question long, query string, namespaces array<string>")
    spaces = {r["question"]: set(r["namespaces"] or "abc") for r in questions.collect()}
    where, scored = {r["id"]: r["namespace"] for r in kept.collect()}, {}
    for r in search.batch_scores(df, questions).collect():
        if where.get(r["id"]) in spaces[r["question"]]:
            scored.setdefault(r["question"], []).append((-r["bm25"], r["id"]))
    pools = benchmark.keyword_pools(df, kept, questions, 8)
    got = {}
    for r in pools.orderBy("question", "br").collect():
        got.setdefault(r["question"], []).append(r["id"])
    assert got == {q: [i for _, i in sorted(x)[:8]] for q, x in scored.items()} and set(got) == {1, 2, 5}
    assert "Generate" not in pools._jdf.queryExecution().optimizedPlan().toString()
