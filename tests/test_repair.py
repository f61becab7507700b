"""Batches of edge repairs in order, against a plain loop over a list of edges."""

import random

import pytest

from lorekeep import schema as S
from lorekeep.operators import repair

EDGES = "edge_id long, source_id {0}, target_id {0}, relation_type string, note string"
OPS = "place long, op string, source_id {0}, target_id {0}, relation_type string, new_type string"


def by_hand(edges, ops):
    """Edges as a list of mutable rows; one op after the other looks at all of them."""
    edges, told = [list(e) for e in edges], {}
    at = lambda s, t, k: [e for e in edges if e[1:4] == [s, t, k]]
    for place, op, s, t, old, new in sorted(ops):
        hit = at(s, t, old)
        if op == "delete" and old is None:
            gone = [e for e in edges if e[1:3] == [s, t]]
            told[place] = ("deleted" if gone else "not_found", sorted({e[3] for e in gone}))
            edges = [e for e in edges if e not in gone]
        elif op == "retype" and (old is None or new is None):
            told[place] = ("error", None)
        elif not hit:
            told[place] = ("not_found", None)
        elif op == "delete":
            edges = [e for e in edges if e not in hit]
            told[place] = ("deleted", None)
        elif op == "retype" and old == new:
            told[place] = ("unchanged", None)
        else:
            to = [s, t, new] if op == "retype" else [t, s, new or old]
            if at(*to):
                edges = [e for e in edges if e not in hit]
                told[place] = ("merged", None)
            else:
                for e in hit:
                    e[1:4] = to
                told[place] = ("retyped" if op == "retype" else "reversed", None)
    return {tuple(e) for e in edges}, told


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_batches(spark, seed):
    rng = random.Random(seed)
    kind = "string" if seed == 2 else "long"
    name = (lambda i: f"u-{i}") if seed == 2 else (lambda i: i)
    two = lambda: map(name, rng.sample(range(5), 2))
    types = S.RELATION_TYPES[:3]
    edges = [(i, *two(), rng.choice(types), f"n{i}") for i in range(30)]
    ops = [(p, op := rng.choice(repair.REPAIRS), *two(), rng.choice(types) if op == "reverse" or rng.random() < 0.8 else None, rng.choice([None, *types]) if op != "delete" else None) for p in rng.sample(range(1000), 80)]
    df = spark.createDataFrame(edges, EDGES.format(kind)).repartition(3)
    after, told = repair.repaired(df, repair.validated(spark.createDataFrame(ops, OPS.format(kind))))
    left, want = by_hand(edges, ops)
    assert {tuple(r) for r in after.collect()} == left and after.columns == df.columns
    assert {r["place"]: (r["outcome"], r["removed_types"]) for r in told.collect()} == want


def test_ops_see_what_earlier_ops_did(spark):
    edges = spark.createDataFrame([(1, 1, 2, "caused_by", "a"), (2, 3, 4, "caused_by", "b"), (3, 3, 4, "parent_of", "c"), (4, 8, 9, "parent_of", "d")], EDGES.format("long"))
    ops = spark.createDataFrame([(2, "reverse", 1, 2, "related_to", None), (1, "retype", 1, 2, "caused_by", "related_to"), (3, "delete", 3, 4, None, None), (4, "delete", 3, 4, "parent_of", None)], OPS.format("long"))
    after, told = repair.repaired(edges, ops)
    assert {tuple(r) for r in after.collect()} == {(1, 2, 1, "related_to", "a"), (4, 8, 9, "parent_of", "d")}
    assert [(r["outcome"], r["removed_types"]) for r in told.orderBy("place").collect()] == [("retyped", None), ("reversed", None), ("deleted", ["caused_by", "parent_of"]), ("not_found", None)]


def test_one_pair_with_very_many_ops(spark):
    ops = spark.range(60_001).selectExpr("id AS place", "'reverse' AS op", "1 + id % 2 AS source_id", "2 - id % 2 AS target_id", "'related_to' AS relation_type", "cast(null AS string) AS new_type")
    after, told = repair.repaired(spark.createDataFrame([(1, 1, 2, "related_to", "a")], EDGES.format("long")), ops)
    assert [tuple(r) for r in after.collect()] == [(1, 2, 1, "related_to", "a")] and {r["outcome"]: r["count"] for r in told.groupBy("outcome").count().collect()} == {"reversed": 60_001}


def test_dry_run_and_guards(spark):
    make = lambda *ops: spark.createDataFrame([(i, *op) for i, op in enumerate(ops)], OPS.format("long"))
    ops = make(("reverse", 1, 2, "caused_by", None), ("retype", 1, 2, "caused_by", "child_of"), ("retype", 1, 2, None, "child_of"), ("delete", 1, 2, "caused_by", None), ("delete", 1, 2, None, None))
    assert [r["outcome"] for r in repair.would(ops).orderBy("place").collect()] == ["would_reverse", "would_retype", "error", "would_delete", "would_delete_all"]
    for bad, match in (
        (("delete", None, 2, None, None), "source_id"), (("delete", 1, 1, None, None), "self edge"), (("drop", 1, 2, None, None), "unknown op"),
        (("delete", 1, 2, "likes", None), "unknown relation_type"), (("retype", 1, 2, "caused_by", "likes"), "unknown relation_type"), (("reverse", 1, 2, None, None), "needs relation_type"),
    ):
        with pytest.raises(ValueError, match=match):
            repair.validated(make(bad))
    with pytest.raises(ValueError, match="nothing to do"):
        repair.validated(make(("delete", 1, 2, None, None)).limit(0))
    with pytest.raises(ValueError, match="at most 100"):
        repair.validated(make(*[("delete", 1, 2, None, None)] * 101))
    with pytest.raises(ValueError, match="share a place"):
        repair.validated(make(("delete", 1, 2, None, None)).union(make(("delete", 1, 3, None, None))))
