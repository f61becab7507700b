"""Session context: quotas over several buckets of memories."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep import schema as S
from lorekeep.functions.scoring import composite


def pinned_bucket(df: DataFrame, most: int = S.PIN_CAP) -> DataFrame:
    anchor = F.coalesce("last_confirmed", "created_at")
    return df.where("pinned AND confidence <> 'deprecated'").orderBy(anchor.desc(), "id").limit(most).select("id", anchor.alias("signal"))


def recent_bucket(df: DataFrame, limit: int) -> DataFrame:
    return df.where("NOT pinned AND confidence <> 'deprecated'").orderBy(F.desc("last_accessed"), "id").limit(limit)


def cross_bucket(df: DataFrame, namespace: str, most: int = S.CROSS_QUOTA) -> DataFrame:
    """Verified patterns and preferences of other namespaces, most used first."""
    other = df.where(F.col("namespace") != namespace).where("type IN ('pattern', 'preference') AND confidence = 'verified'")
    return other.orderBy(F.desc("access_count"), "id").limit(most)


def contexts(df: DataFrame, sessions: DataFrame, now: Column, task: DataFrame | None = None, limit: int = S.CONTEXT_LIMIT) -> DataFrame:
    """(session, id, bucket, position) of all ``sessions`` (session, namespace) at once: pins, then task, recent, cross-namespace and backfill picks.

    ``task`` has (session, id, score) from searches.  An id counts in the first bucket that picks it (recent, task, cross);
    architecture and decision records get a boost of their score.  Buckets are cut within each namespace before sessions meet them, and what every
    other step sees of a session are some tens of rows in windows of its own.
    """
    quota = {"recent": max(1, math.ceil(S.RECENT_SHARE * limit)), "task": max(1, math.ceil(S.TASK_SHARE * limit)), "cross": S.CROSS_QUOTA}
    kept = df.where("confidence <> 'deprecated'")
    boost = F.when(F.col("type").isin("architecture", "decision"), S.TYPE_BOOST).otherwise(0.0)
    score = composite(F.lit(0.5), now) + boost
    first = lambda d, n, *order, by="namespace": d.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n)

    anchor = F.coalesce("last_confirmed", "created_at")
    pins = first(kept.where("pinned"), S.PIN_CAP, anchor.desc(), F.col("id")).select("namespace", "id", F.col("_n").alias("place"))
    pins = sessions.join(pins, "namespace").select("session", "id", "place")
    recent = first(kept.where("NOT pinned"), limit, F.desc("last_accessed"), F.col("id"))
    seconds = F.timestamp_diff("SECOND", F.lit("2000-01-01").cast("timestamp_ntz"), F.col("last_accessed")).cast("double")
    rows = sessions.join(recent.select("namespace", "id", seconds.alias("signal"), score.alias("score")), "namespace").select("session", "id", F.lit("recent").alias("bucket"), "signal", "score")
    # no namespace has more than CROSS_QUOTA rows among these, so the first twice as many hold enough of others
    cross = first(kept.where("type IN ('pattern', 'preference') AND confidence = 'verified'"), S.CROSS_QUOTA, F.desc("access_count"), F.col("id"))
    cross = cross.orderBy(F.desc("access_count"), "id").limit(2 * S.CROSS_QUOTA).select(F.col("namespace").alias("of"), "id", F.col("access_count").cast("double").alias("signal"), score.alias("score"))
    foreign = sessions.join(F.broadcast(cross), F.col("namespace") != F.col("of"))
    foreign = first(foreign, S.CROSS_QUOTA, F.desc("signal"), F.col("id"), by="session")
    rows = rows.union(foreign.select("session", "id", F.lit("cross"), "signal", "score"))
    if task is not None:
        found = task.select("session", "id", F.col("score").alias("signal")).join(kept.where("NOT pinned").select("id", boost.alias("boost")), "id")
        rows = rows.union(found.select("session", "id", F.lit("task"), "signal", F.col("signal") + F.col("boost")))
    rows = rows.join(pins.select("session", "id"), ["session", "id"], "left_anti")

    by_id, turn = Window.partitionBy("session", "id"), F.when(F.col("bucket") == "recent", 0).when(F.col("bucket") == "task", 1).otherwise(2)
    rows = rows.withColumns({"turn": turn, "best": F.max("score").over(by_id), "taken": F.lit(False), "picked": F.lit(False), "place": F.lit(0)})
    for i, name in enumerate(("recent", "task", "cross")):
        may = (F.col("turn") == i) & ~F.col("taken")
        place = F.row_number().over(Window.partitionBy("session", "may").orderBy(F.desc("signal"), F.desc("best"), F.desc("id")))
        rows = rows.withColumn("may", may).withColumn("_p", place).withColumn("now", F.col("may") & (F.col("_p") <= quota[name]))
        rows = rows.withColumns({"picked": F.col("picked") | F.col("now"), "place": F.when(F.col("now"), F.col("_p")).otherwise(F.col("place")), "taken": F.col("taken") | F.max("now").over(by_id)})
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("session", "picked").orderBy("turn", "place")))
    rows = rows.withColumn("chosen", F.col("picked") & (F.col("n") <= limit)).drop("may", "_p", "now", "taken")
    rows = rows.withColumn("held", F.max("chosen").over(by_id)).withColumn("count", F.count_if("chosen").over(Window.partitionBy("session")))
    # ids that no bucket chose, once each
    rows = rows.withColumn("once", F.row_number().over(by_id.orderBy("turn"))).withColumn("spare", ~F.col("held") & (F.col("once") == 1))
    rows = rows.withColumn("back", F.row_number().over(Window.partitionBy("session", "spare").orderBy(F.desc("best"), "id")))
    filled = F.col("spare") & (F.col("back") <= F.lit(limit) - F.col("count"))
    picks = rows.where(F.col("chosen") | filled).select("session", "id", F.when(F.col("chosen"), F.col("bucket")).otherwise("backfill").alias("bucket"), F.when(F.col("chosen"), F.col("place")).otherwise(F.col("back")).alias("place"))
    every = pins.select("session", "id", F.lit("pinned").alias("bucket"), "place").union(picks)
    shown = F.when(F.col("bucket") == "pinned", 0).when(F.col("bucket") == "task", 1).when(F.col("bucket") == "recent", 2).when(F.col("bucket") == "cross", 3).otherwise(4)
    return every.select("session", "id", "bucket", F.row_number().over(Window.partitionBy("session").orderBy(shown, "place", "id")).alias("position"))


def selected(df: DataFrame, namespace: str, now: Column, task: DataFrame | None = None, limit: int = S.CONTEXT_LIMIT) -> DataFrame:
    """(id, bucket, position) of one session; ``task`` has (id, score)."""
    session = df.sparkSession.range(1).select(F.lit(0).alias("session"), F.lit(namespace).alias("namespace"))
    asked = task.select(F.lit(0).alias("session"), "id", "score") if task is not None else None
    return contexts(df, session, now, asked, limit).drop("session")


def merged(rows: DataFrame) -> DataFrame:
    """(group, id, bucket, session, place) of contexts (group, turn, session, id, bucket, position) that belong together: all pins first, then the tails in turn; an id at its first place."""
    order = [F.when(F.col("bucket") == "pinned", 0).otherwise(1), F.col("position"), F.col("turn")]
    first = rows.withColumn("seen", F.row_number().over(Window.partitionBy("group", "id").orderBy(*order))).where("seen = 1")
    return first.select("group", "id", "bucket", "session", F.row_number().over(Window.partitionBy("group").orderBy(*order, "id")).alias("place"))
