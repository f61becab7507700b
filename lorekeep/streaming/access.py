"""Access counts from a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import schema as S


def windowed_accesses(stream: DataFrame, time: str = "accessed_at", key: str = "context", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Accesses for each window and key; rows later than the watermark are dropped."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def started(stream: DataFrame, path: str, checkpoint: str):
    """Append finished windows to Parquet files, exactly once; stops when the source is read."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


DAY_MS = 86_400_000


def retained_counts(stream: DataFrame, days: int = S.LOG_DAYS, late: str = "10 minutes") -> DataFrame:
    """(memory_id, n, last) of a stream of accesses (memory_id, accessed_at), whenever a memory's count changes.

    The state of a memory is a count for each day and the time of its last access.  A day expires when the watermark is ``days`` past its end,
    by a timer, so a memory that nobody reads any more comes once with what is left, at last with 0, and then has no state.
    The last row of each memory over all batches is what ``retained`` gives for the whole log at that watermark.
    """
    kind = stream.schema["memory_id"].dataType.simpleString()
    timed = stream.select("memory_id", F.col("accessed_at").cast("timestamp").alias("accessed_at")).withWatermark("accessed_at", late)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, last = {}, 0
        if state.exists:
            names, counts, last = state.get
            held = dict(zip(names, counts, strict=True))
        if not state.hasTimedOut:
            for frame in frames:
                ms = frame["accessed_at"].astype("datetime64[us]").astype("int64") // 1000
                for day, n in (ms // DAY_MS).value_counts().items():
                    held[int(day)] = held.get(int(day), 0) + int(n)
                last = max(last, int(frame["accessed_at"].astype("datetime64[us]").astype("int64").max()))
        now = state.getCurrentWatermarkMs()
        held = {d: n for d, n in held.items() if expiry(d, days) > now}
        if held:
            names = sorted(held)
            state.update((names, [held[d] for d in names], last))
            state.setTimeoutTimestamp(expiry(names[0], days))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"memory_id": [key[0]], "n": [sum(held.values())], "last": [pd.Timestamp(last, unit="us")]})

    return timed.groupBy("memory_id").applyInPandasWithState(fold, f"memory_id {kind}, n long, last timestamp", "days array<long>, counts array<long>, last long", "update", "EventTimeTimeout")


def expiry(day: int, days: int) -> int:
    """The time, in milliseconds, at which a day's accesses expire."""
    return (day + 1 + days) * DAY_MS


def retained(log: DataFrame, watermark_ms: int, days: int = S.LOG_DAYS) -> DataFrame:
    """(memory_id, n, last) of a whole log (memory_id, accessed_at) at a watermark: the batch form of ``retained_counts``."""
    day = F.floor(F.unix_millis(F.col("accessed_at").cast("timestamp")) / DAY_MS)
    kept = (day + 1 + days) * DAY_MS > watermark_ms
    found = log.groupBy("memory_id").agg(F.count_if(kept).alias("n"), F.max(F.col("accessed_at").cast("timestamp")).alias("last"))
    return found.where("n > 0")


def kept_counts(stream: DataFrame, path: str, checkpoint: str, days: int = S.LOG_DAYS):
    """Run ``retained_counts`` over what the source has, each batch's rows below ``path``; a batch that runs again replaces its own rows."""

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = retained_counts(stream, days).writeStream.outputMode("update").foreachBatch(put)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """(memory_id, n, last): the last row of each memory that ``kept_counts`` wrote, without those that have expired."""
    rows = spark.read.parquet(path)
    one = rows.groupBy("memory_id").agg(F.max_by(F.struct("n", "last"), "batch").alias("r"))
    return one.select("memory_id", "r.n", "r.last").where("n > 0")
