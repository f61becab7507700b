"""Mixing sources to target weights by capped water-filling.

Each source has a size and a weight.  The words to draw are shared by weight; a
source is clamped at ``max_epochs`` times its size and what it cannot take is
shared again, in proportion to weight, until no source is above its cap.  A
source's repetition factor is target / size: every document is taken the whole
part of it, and a seeded sample of documents once more for the fraction.

The sample keeps each source close to its target: documents are split by size
class, and each class by a seeded hash into bins.  From the largest class to the
smallest a cut over the bins is set, rounded at random to a bin's edge, and what a class
misses is carried to the next.  Cuts need one row for each source, class and bin,
whatever the number of documents; a document then compares its own bin with the cut.

Defined results: a null text has size 0; documents of size 0 are taken the whole part
of their source's factor (never for their fraction).  A null source is a source of its
own.  Repeated rows are decided alike.  A weight that is null, negative or not given
counts as 0 and such a source has target 0.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import small, table, unit_hash

#: Bins of a size class of a source.
BINS = 256
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: Column, max_epochs: float) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``.

    In order of cap / weight the clamped sources come first.  With the first i clamped the level
    is (total - their caps) / (weight of the others); the first source that stays under its cap at its own
    level ends the clamping.  One row for each source passes through the windows.
    """
    weight = F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(0.0)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    own = sources.withColumns({"_w": weight, "_cap": F.col("source_size") * float(max_epochs), "_total": total})
    paid = own.where("_w > 0").withColumns(
        {
            "_before": F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_rest": F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    level = paid.withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_rest"))
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    level = level.withColumn("_final", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    clamp = F.least("_cap", F.coalesce(F.col("_final") * F.col("_w"), F.col("_cap")))
    unpaid = own.where("_w = 0").withColumn("target", F.lit(0.0))
    return level.withColumn("target", clamp).select(*sources.columns, "target").unionByName(unpaid.select(*sources.columns, "target"))


def _cuts(group: pd.DataFrame) -> pd.DataFrame:
    """The cut of every size class of one source, largest class first."""
    carry, out = 0.0, []
    part = float(group["fraction"].iloc[0])
    for level in sorted(group["level"].unique(), reverse=True):
        rows = group[group["level"] == level].sort_values("bin")
        ends = rows["words"].cumsum().to_numpy(dtype=float)
        want = min(max(part * ends[-1] + carry, 0.0), ends[-1]) if part > 0 else 0.0
        i = int((ends < want).sum())
        low, high = (ends[i - 1] if i else 0.0), (ends[i] if i < len(ends) else ends[-1])
        # either edge is drawn if the smaller classes can make up for it, else the one that they can
        rest = float(group.loc[group["level"] < level, "words"].sum())
        room, excess = want - low <= (1.0 - part) * rest, high - want <= part * rest
        if room == excess:
            up = float(rows["toss"].iloc[0]) < (want - low) / (high - low) if room and high > low else high - want < want - low
        else:
            up = excess
        up = up and high > low
        cut = int(rows["bin"].iloc[i]) + 1 if up else (int(rows["bin"].iloc[i - 1]) + 1 if i else 0)
        carry += part * ends[-1] - (high if up else low)
        out.append((int(level), cut))
    return pd.DataFrame({"source": [group["source"].iloc[0]] * len(out), "level": [x for x, _ in out], "cut": [x for _, x in out]})


def mix(docs: DataFrame, weights, share: float, max_epochs: float, seed: int = 7, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``epochs`` and ``taken``; other columns stay.

    ``weights`` gives each row of (source, source_size) a ``weight`` column; ``share`` is the words to draw as
    a part of all words.  ``epochs`` is how often the document is taken.
    """
    plan = _planned(docs, weights, share, max_epochs, seed, source, text, key)
    kept = [F.col(f"_row.{c}") for c in docs.columns if c not in RESULT]
    return plan.select(*kept, *RESULT)


RESULT = ("size", "source_size", "target", "epochs", "taken")


def _planned(docs: DataFrame, weights, share: float, max_epochs: float, seed: int, source: str, text: str, key: str) -> DataFrame:
    """The rows of ``docs`` as ``_row``, with the columns of RESULT."""
    bins = F.floor(unit_hash(F.col("_key"), seed=seed) * BINS).cast("int")
    level = F.floor(F.log2(F.greatest("size", F.lit(1)).cast("double"))).cast("int")
    base = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    sized = base.withColumns({"_level": level, "_bin": bins})
    # source, size class and bin: all that the targets and the cuts need
    hist = sized.groupBy("source", F.col("_level").alias("level"), F.col("_bin").alias("bin")).agg(F.sum("size").alias("words"))
    hist = hist.persist()
    sizes = hist.groupBy("source").agg(F.sum("words").alias("source_size"))
    everything = hist.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first()["n"]
    targets = water_fill(weights(sizes), F.lit(float(everything * share)), max_epochs)
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumns({"whole": F.floor(factor).cast("long"), "fraction": factor - F.floor(factor)}).select("source", "source_size", "target", "whole", "fraction")
    targets = targets.persist()
    open_ = targets.where("fraction > 0").select("source", "fraction")
    toss = unit_hash(F.coalesce("source", F.lit("")), F.col("level"), seed=seed + 1)
    rows = hist.join(small(open_), hist["source"].eqNullSafe(open_["source"])).drop(open_["source"]).withColumn("toss", toss)
    cuts = rows.groupBy("source").applyInPandas(_cuts, "source string, level int, cut int")
    plan = _lookup(sized, small(targets), {"source": "source"})
    plan = _lookup(plan, small(cuts.persist()), {"source": "source", "_level": "level"})
    epochs = F.col("whole") + F.when((F.col("size") > 0) & (F.col("_bin") < F.col("cut")), 1).otherwise(0)
    done = plan.withColumn("epochs", epochs.cast("long")).withColumn("taken", F.col("epochs") * F.col("size"))
    return done.select("_row", *RESULT)


def _lookup(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Left join on null-safe keys; the keys of ``right`` go."""
    right = right.select(*[F.col(b).alias(f"_key_{b}") if b in keys.values() else b for b in right.columns])
    on = [left[a].eqNullSafe(right[f"_key_{b}"]) for a, b in keys.items()]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(right, cond, "left").drop(*[f"_key_{b}" for b in keys.values()])


def cycling_weights(cycle: tuple[float, ...]):
    """Weights dealt to the sources in code point order, null last, over and over."""

    def give(sizes: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
        return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (rank % len(cycle) + 1).cast("int")))

    return give


OP9 = {"weights": cycling_weights((3, 1, 2)), "share": 1.5, "max_epochs": 2.0}


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """Mix all of ``documents``; one row for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, **OP9).select("doc_id", "size", "source_size", "target", "taken", "epochs", "source")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every document as often as the mix takes it."""
    taken = _planned(docs, **OP9, seed=7, source="source", text="text", key="doc_id").where("epochs > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("epochs"))).alias("_copy")).select("_row.*")
