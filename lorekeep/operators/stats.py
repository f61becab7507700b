"""Corpus health, counts and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep import schema as S
from lorekeep.functions.scoring import days_between, deprecation_suggested, dormant, health


def counts(memories: DataFrame, now: Column, dormant_days: int = S.DORMANT_DAYS, deprecate_days: int = S.DEPRECATE_DAYS) -> DataFrame:
    """One row: all, active, dormant, deprecation suggested, pinned."""
    active = F.col("confidence") != "deprecated"
    return memories.agg(
        F.count("*").alias("total"),
        F.count_if(active).alias("active"),
        F.count_if(active & dormant(now, dormant_days)).alias("dormant"),
        F.count_if(active & deprecation_suggested(now, deprecate_days)).alias("suggested"),
        F.count_if(F.col("pinned") & active).alias("pinned"),
    )


def outcomes(repaired: DataFrame) -> DataFrame:
    """How often each outcome of a repair occurred."""
    return repaired.groupBy("outcome").agg(F.count("*").alias("n"))


def by(memories: DataFrame, *columns: str) -> DataFrame:
    return memories.groupBy(*columns).agg(F.count("*").alias("n"))


def namespace_counts(namespaces: DataFrame, memories: DataFrame) -> DataFrame:
    """Memories of every namespace, none included."""
    held = memories.groupBy(F.col("namespace").alias("name")).agg(F.count("*").alias("n"))
    return namespaces.join(held, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def ghosts(namespaces: DataFrame, memories: DataFrame) -> DataFrame:
    return namespaces.join(memories.select(F.col("namespace").alias("name")).distinct(), "name", "left_anti")


def pins(memories: DataFrame) -> DataFrame:
    """Active pins by namespace and whether there is room for another."""
    own = memories.where("pinned AND confidence <> 'deprecated'").groupBy("namespace").agg(F.count("*").alias("pins"))
    return own.withColumn("full", F.col("pins") >= S.PIN_CAP)


def expiry(services: DataFrame, now: Column, soon_days: int = S.REVIEW_DAYS) -> DataFrame:
    """Services (service, expires_at) by state of expiry."""
    left = F.timestamp_diff("SECOND", now, F.col("expires_at")) / 86400.0
    return services.agg(F.count("*").alias("total"), F.count_if(left < 0).alias("expired"), F.count_if((left >= 0) & (left <= soon_days)).alias("expiring_soon"))


def retained_log(log: DataFrame, now: Column, days: int = S.LOG_DAYS) -> DataFrame:
    return log.where(F.col("accessed_at") >= now - F.make_dt_interval(days=F.lit(days)))


def log_by_context(log: DataFrame) -> DataFrame:
    return log.groupBy("context").agg(F.count("*").alias("n"), F.countDistinct("memory_id").alias("memories"))


def tag_counts(memories: DataFrame) -> DataFrame:
    return memories.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def bucket_of(column: str, unit: str) -> Column:
    """day ``2024-01-31``, week ``2024-W05`` (ISO), month ``2024-01``; ``unknown`` for null."""
    t = F.col(column)
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), t).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))
    name = {"day": F.date_format(t, "yyyy-MM-dd"), "week": week, "month": F.date_format(t, "yyyy-MM")}[unit]
    return F.coalesce(name, F.lit("unknown"))


def timeline(memories: DataFrame, unit: str = "day", column: str = "created_at") -> DataFrame:
    return memories.groupBy(bucket_of(column, unit).alias("bucket")).agg(F.count("*").alias("n"))


def stacked_by_type(memories: DataFrame, unit: str = "week") -> DataFrame:
    """One column for each type."""
    return memories.groupBy(bucket_of("created_at", unit).alias("bucket")).pivot("type", list(S.MEMORY_TYPES)).count().na.fill(0)


def activity(memories: DataFrame, unit: str = "day") -> DataFrame:
    last = memories.withColumn("_t", F.coalesce("last_accessed", "updated_at", "created_at"))
    return timeline(last, unit, "_t")


def span(memories: DataFrame) -> DataFrame:
    """First and last day, their distance in days (at least one) and memories a day."""
    one = memories.agg(F.min("created_at").alias("a"), F.max("created_at").alias("b"), F.count("*").alias("n"))
    days = F.greatest(F.lit(1), F.round(days_between("a", F.col("b"))).cast("long"))
    return one.select(F.date_format("a", "yyyy-MM-dd").alias("first_day"), F.date_format("b", "yyyy-MM-dd").alias("last_day"), days.alias("days"), F.round(F.col("n") / days, 2).alias("per_day"))


def health_summary(memories: DataFrame, now: Column, dormant_days: int = S.DORMANT_DAYS) -> DataFrame:
    h = health(now)
    return memories.agg(
        F.count_if(h >= 0.7).alias("healthy"),
        F.count_if((h >= 0.4) & (h < 0.7)).alias("fading"),
        F.count_if(h < 0.4).alias("stale"),
        F.count_if(dormant(now, dormant_days)).alias("dormant"),
    )


def cards(memories: DataFrame, relations: DataFrame) -> DataFrame:
    """Totals of the dashboard's cards."""
    m = memories.agg(F.count("*").alias("memories"), F.count_if(F.col("confidence") == "verified").alias("verified"), F.countDistinct("namespace").alias("namespaces"))
    t = memories.select(F.explode("tags").alias("tag")).agg(F.countDistinct("tag").alias("tags"))
    return F.broadcast(m).join(F.broadcast(t)).join(F.broadcast(relations.agg(F.count("*").alias("relations"))))


def node_sizes(memories: DataFrame) -> DataFrame:
    size = F.greatest(F.lit(3), F.least(F.lit(12), 2 * F.size("tags") + F.col("access_count") + 3))
    return memories.select("id", size.cast("long").alias("size"))


def grouped_by_decay(memories: DataFrame, now: Column, by: str = "health", group: str = "namespace") -> DataFrame:
    """``memories`` with their place in their group: least healthy, longest idle, least used or latest made first."""
    order = {"health": health(now).asc(), "days": days_between("last_accessed", now).desc(), "access": F.col("access_count").asc(), "created": F.col("created_at").desc()}[by]
    return memories.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order, "id")))
