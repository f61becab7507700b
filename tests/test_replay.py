"""Replays of random logs against a plain loop, and what is derived again afterwards."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_operators import COLUMNS, EDGES, memory

from lorekeep.operators import claims, replay

LOG = "place long, at timestamp_ntz, op string, id {0}, namespace string, type string, title string, content string, confidence string, source string, metadata string, pinned boolean, tags array<string>, target_id {0}, relation_type string"
START = datetime(2024, 3, 1)


def op(place, name, id_, **more):
    fields = dict.fromkeys(("namespace", "type", "title", "content", "confidence", "source", "metadata", "pinned", "tags", "target_id", "relation_type")) | more
    return (place, START + timedelta(minutes=place), name, id_, *fields.values())


def snapshot(spark, rows, kind="long"):
    columns = COLUMNS if kind == "long" else COLUMNS.replace("id long", "id string")
    return spark.createDataFrame(rows, columns).withColumn("metadata", F.lit('{"k": 1}'))


def by_hand(rows, edges, log):
    """Dictionaries and lists, one operation after the other."""
    held, edges, told = {r["id"]: dict(r) for r in rows}, [tuple(e) for e in edges], {}
    for place, at, name, i, ns, kind, title, content, conf, _, meta, pinned, tags, target, rel in sorted(log, key=lambda x: x[0]):
        row = held.get(i)
        clean = list(dict.fromkeys("-".join(t.strip().lower().split()) for t in tags or []))
        if name == "relate":
            if i == target or rel not in ("caused_by", "related_to"):
                told[place] = "error"
            elif row is None or target not in held:
                told[place] = "not_found"
            elif any(e[1:] == (i, target, rel) for e in edges):
                told[place] = "exists"
            else:
                edges.append((place, i, target, rel))
                told[place] = "related"
        elif conf == "sure" or meta == "[1]" and (name == "update" and row or name == "store" and not row):
            told[place] = "error"
        elif name == "store":
            told[place] = "exists" if row else "stored"
            if not row:
                held[i] = {"id": i, "namespace": ns, "type": kind, "title": title, "content": content, "confidence": conf or "inferred", "created_at": at, "updated_at": at, "last_accessed": at, "last_confirmed": at if conf == "verified" else None, "access_count": 0, "pinned": False, "tags": clean, "metadata": meta or None}
        elif row is None:
            told[place] = "not_found"
        elif name == "delete":
            del held[i]
            edges = [e for e in edges if i not in e[1:3]]
            told[place] = "deleted"
        elif name == "forget":
            row |= {"confidence": "deprecated", "updated_at": at}
            told[place] = "deprecated"
        elif name in ("access", "touch"):
            row |= {"last_accessed": at, "access_count": row["access_count"] + (name == "access")}
            told[place] = name + ("ed" if name == "access" else "ed")
        elif name == "tag":
            row["tags"] = list(dict.fromkeys([*row["tags"], *clean]))
            told[place] = "tagged"
        else:
            text = title is not None and title != row["title"] or content is not None and content != row["content"]
            new = {"title": title, "content": content, "type": kind, "confidence": conf, "pinned": pinned, "tags": clean if tags is not None else None}
            row |= {k: v for k, v in new.items() if v is not None} | {"updated_at": at}
            if meta is not None:
                row["metadata"] = meta or None
            if text or conf == "verified":
                row["last_confirmed"] = at
            told[place] = "updated"
    return held, set(edges), told


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_logs(spark, seed):
    rng = random.Random(seed)
    kind, name = ("string", lambda i: f"m-{i}") if seed == 2 else ("long", lambda i: i)
    rows = [memory(name(i), f"t{i}", f"c{i}", tags=["a"]) for i in range(8)]
    edges = [(1000 + i, name(rng.randrange(4)), name(4 + rng.randrange(4)), "caused_by") for i in range(4)]
    edges = list({e[1:]: e for e in edges}.values())
    log = []
    for place in rng.sample(range(5000), 160):
        what, i = rng.choice(["store", "update", "update", "forget", "delete", "access", "touch", "tag", "relate", "relate"]), name(rng.randrange(11))
        more = {}
        if what in ("store", "update"):
            more = {"confidence": rng.choice([None, "verified", "stale", "sure"]), "metadata": rng.choice([None, "", '{"x": 2}', "[1]"]), "tags": rng.choice([None, [" B c", "b  c"], []])}
            more |= {"title": rng.choice([None, "new", f"t{i}"]), "content": rng.choice([None, "text"]), "type": rng.choice([None, "bug"]), "pinned": rng.choice([None, True])}
        if what == "store":
            more |= {"namespace": "n", "type": "fact", "title": "again", "content": "stored"}
        if what == "tag":
            more = {"tags": [rng.choice(["X", "y z"])]}
        if what == "relate":
            more = {"target_id": name(rng.randrange(11)), "relation_type": rng.choice(["caused_by", "related_to", "likes"])}
        log.append(op(place, what, i, **more))
    df = snapshot(spark, rows, kind)
    done = replay.replayed(df, spark.createDataFrame(edges, EDGES.replace("id long", f"id {kind}").replace("edge_id string", "edge_id long")), spark.createDataFrame(log, LOG.format(kind)).repartition(5))
    held, left, told = by_hand([r.asDict() for r in df.collect()], edges, log)
    assert {r["id"]: r.asDict() for r in done.memories.collect()} == held
    assert {tuple(r) for r in done.relations.collect()} == left
    assert {r["place"]: r["outcome"] for r in done.outcomes.collect()} == told
    first = {r[0]: r for r in rows}
    was = {r["id"]: (r["title"], r["content"]) for r in df.collect()}
    assert {r["id"] for r in done.moved.collect()} == {i for i, r in held.items() if was.get(i) != (r["title"], r["content"])}
    assert {r["id"] for r in done.gone.collect()} >= set(first) - set(held)
    assert done.accesses.count() == sum(v == "accessed" for v in told.values())


def test_claims_and_vectors_follow_the_texts(spark):
    df = snapshot(spark, [memory(1, "x", "PR #1 open"), memory(2, "x", "PR #1 merged"), memory(3, "x", "PR #3 open"), memory(4, "x", "plain")])
    repo = F.col("namespace")
    old = claims.extract(df, repo).withColumn("resolved_state", F.when(F.col("memory_id") == 3, "resolved"))
    log = [op(1, "update", 2, content="PR #1 pending"), op(2, "update", 3, content="PR #3 open still"), op(3, "delete", 1), op(4, "store", 9, namespace="n", type="fact", title="y", content="PR #9 merged"), op(5, "update", 4, confidence="verified")]
    done = replay.replayed(df, spark.createDataFrame([], EDGES), spark.createDataFrame(log, LOG.format("long")))
    after, change = replay.claims_after(old, done, repo)
    assert {(r["memory_id"], r["state"], r["resolved_state"]) for r in after.collect()} == {(2, "open", None), (3, "open", "resolved"), (9, "resolved", None)}
    assert {(r["memory_id"], r["change"]) for r in change.collect()} == {(2, "changed"), (3, "changed"), (9, "added")}
    full = claims.extract(done.memories, repo)
    assert sorted(map(tuple, after.select(full.columns).collect())) == sorted(map(tuple, full.collect()))
    vectors = spark.createDataFrame([(i, [float(i)]) for i in (1, 2, 3, 4)], "id long, vector array<double>")
    new = {r["id"]: r["vector"] for r in replay.vectors_after(vectors, done, lambda texts: [[100.0 + len(t)] for t in texts], 1).collect()}
    assert new[4] == [4.0] and set(new) == {2, 3, 4, 9} and all(new[i][0] > 100 for i in (2, 3, 9))


def test_random_edits_of_claims(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"PR #{rng.randrange(4)} {rng.choice(['open', 'merged', 'x', 'pending'])}." + " filler" * 20 for _ in range(rng.randrange(3)))
    rows = {i: memory(i, "x", text(), confidence=rng.choice(["verified", "deprecated"])) for i in range(25)}
    repo, active = F.col("namespace"), lambda d: d.where("confidence <> 'deprecated'").select("id")
    df = snapshot(spark, list(rows.values()))
    held = claims.extract(df, repo).withColumn("resolved_state", F.lit(None).cast("string"))
    against = claims.contradicted(held, active(df))
    moved, gone, fresh = rng.sample(range(25), 8), [], {}
    moved, gone = moved[:5], moved[5:]
    for i in [*moved, 77]:
        fresh[i] = memory(i, "x", text(), confidence="verified")
    new = snapshot(spark, [r for i, r in (rows | fresh).items() if i not in gone])
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id long")
    after = claims.synchronised(held, new.where(F.col("id").isin([*moved, 77])), ids([*moved, 77]), ids(gone), repo)[0]
    full = claims.extract(new, repo)
    assert sorted(map(str, after.select(full.columns).collect())) == sorted(map(str, full.collect()))
    found = claims.contradicted_after(against, after, active(new), claims.touched_refs(held, after, ids([*moved, 77, *gone])))
    want = claims.contradicted(full, active(new)).select(found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
