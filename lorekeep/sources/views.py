"""A knowledge corpus derived from the given tables, in Spark and in SQL.

Documents are the memories; labels give their confidence, events their times and
accesses; relations and claims follow from the ids.  ``SQL`` has the same views as
common table expressions, so every query can be held against DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import schema as S
from lorekeep.sources.tables import table

NOW = "2024-02-15 00:00:00"


def now():
    """The literal that stands for the present."""
    return F.lit(NOW).cast("timestamp_ntz")


def _documents(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "documents").count()


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, memory_id, accessed_at, context)."""
    n = _documents(spark, sf_dir)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("log_id"), (F.col("event_id") * F.col("event_id") % n).alias("memory_id"), F.col("ts").alias("accessed_at"), F.col("event_type").alias("context"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, events = (table(spark, sf_dir, t) for t in ("documents", "labels", "events"))
    log = access_log(spark, sf_dir).groupBy(F.col("memory_id").alias("doc_id")).agg(F.count("*").alias("n"), F.max("accessed_at").alias("last"))
    made = events.select(F.col("event_id").alias("doc_id"), F.col("ts").alias("given"))
    no_event = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("doc_id") % 30).cast("int"))
    kind = F.element_at(F.array(*[F.lit(t) for t in S.MEMORY_TYPES]), (F.col("doc_id") % 8 + 1).cast("int"))
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    confidence = F.when(good, "verified").when(F.col("quality") == 1, "stale").when(F.col("quality") == 0, "deprecated").otherwise("inferred")
    days = lambda c, m: c + F.make_dt_interval(days=(F.col("doc_id") % m).cast("int"))
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long")
    joined = docs.join(labels, "doc_id", "left").join(made, "doc_id", "left").join(log, "doc_id", "left").withColumn("ts", F.coalesce("given", no_event))
    return joined.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("namespace"),
        kind.alias("type"),
        F.substring("text", 1, 40).alias("title"),
        F.col("text").alias("content"),
        confidence.alias("confidence"),
        F.col("ts").alias("created_at"),
        days(F.col("ts"), 20).alias("updated_at"),
        F.coalesce("last", "ts").alias("last_accessed"),
        F.when(good, days(F.col("ts"), 10)).alias("last_confirmed"),
        F.coalesce("n", F.lit(0)).cast("long").alias("access_count"),
        (F.col("doc_id") % 37 == 0).alias("pinned"),
        F.array("lang", "source", size).alias("tags"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, namespace, title, content) of ``memories``, read from the documents alone, so that no text is sent for the sake of a join.

    Only where a document has several labels or events, each of which gives a memory, they are joined.
    """
    for name, key in (("labels", "doc_id"), ("events", "event_id")):
        held = table(spark, sf_dir, name).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
        if not held.where("n > 1").isEmpty():
            return memories(spark, sf_dir).select("id", "namespace", "title", "content")
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("namespace"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, source_id, target_id, relation_type): no self edges, some memories without any."""
    n = _documents(spark, sf_dir)
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"))
    kind = F.element_at(F.array(*[F.lit(t) for t in S.RELATION_TYPES]), (F.col("source_id") % 6 + 1).cast("int"))
    first = ids.where("source_id % 5 IN (1, 2, 3)").select((F.col("source_id") * 2).alias("edge_id"), "source_id", ((F.col("source_id") * 31 + 7) % n - (F.col("source_id") * 31 + 7) % n % 5).alias("target_id"), kind.alias("relation_type"))
    second = ids.where("source_id % 3 = 0 AND source_id % 5 <> 4").select((F.col("source_id") * 2 + 1).alias("edge_id"), "source_id", (F.floor(F.col("source_id") / 10) * 10 + 5).alias("target_id"), F.lit("related_to").alias("relation_type"))
    return first.union(second).where(F.col("source_id") != F.col("target_id")).where(F.col("target_id") < n)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector) with double components."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


def claim_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories with a pull request mentioned at the end of their content."""
    state = F.element_at(F.array(F.lit(" merged"), F.lit(" open"), F.lit("")), (F.col("id") % 3 + 1).cast("int"))
    text = F.concat("content", F.lit("\nPR #"), (F.col("id") % 50).cast("string"), state)
    return memories(spark, sf_dir).withColumn("content", text)


SQL = """
WITH access_log AS (
  SELECT event_id AS log_id, event_id * event_id % (SELECT count(*) FROM documents) AS memory_id, ts AS accessed_at, event_type AS context FROM events
), acc AS (
  SELECT memory_id, count(*) AS n, max(accessed_at) AS last FROM access_log GROUP BY memory_id
), made AS (
  SELECT doc_id, coalesce(ts, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 30 AS INT))) AS ts FROM (SELECT DISTINCT doc_id FROM documents) x LEFT JOIN events ON event_id = doc_id
), memories AS (
  SELECT d.doc_id AS id, d.source AS namespace,
         (['fact','decision','pattern','bug','architecture','preference','workflow','context'])[d.doc_id % 8 + 1] AS type,
         substr(d.text, 1, 40) AS title, d.text AS content,
         CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'verified' WHEN l.quality = 1 THEN 'stale' WHEN l.quality = 0 THEN 'deprecated' ELSE 'inferred' END AS confidence,
         e.ts AS created_at, e.ts + to_days(CAST(d.doc_id % 20 AS INT)) AS updated_at, coalesce(acc.last, e.ts) AS last_accessed,
         CASE WHEN l.quality = 1 AND l.toxic = 0 THEN e.ts + to_days(CAST(d.doc_id % 10 AS INT)) END AS last_confirmed,
         CAST(coalesce(acc.n, 0) AS BIGINT) AS access_count, d.doc_id % 37 = 0 AS pinned,
         [d.lang, d.source, CASE WHEN d.n_chars < 500 THEN 'short' WHEN d.n_chars < 2000 THEN 'medium' ELSE 'long' END] AS tags
  FROM documents d LEFT JOIN labels l USING (doc_id) JOIN made e ON e.doc_id = d.doc_id LEFT JOIN acc ON acc.memory_id = d.doc_id
), scored AS (
  SELECT *, greatest(last_confirmed, updated_at, created_at) AS anchor,
         greatest(0, epoch_us(TIMESTAMP '2024-02-15') - epoch_us(greatest(last_confirmed, updated_at, created_at))) / 86400000000.0 AS age_days,
         0.35 + 0.65 * exp(-0.01 * (greatest(0, epoch_us(TIMESTAMP '2024-02-15') - epoch_us(greatest(last_confirmed, updated_at, created_at))) / 86400000000.0)) AS fresh,
         CASE WHEN access_count <= 0 THEN 0 ELSE least(1.0, ln(access_count + 1.0) / ln(50.0)) END AS access,
         CASE confidence WHEN 'verified' THEN 1.0 WHEN 'inferred' THEN 0.7 WHEN 'stale' THEN 0.3 ELSE 0.0 END AS trust,
         CASE confidence WHEN 'verified' THEN 3 WHEN 'inferred' THEN 2 WHEN 'stale' THEN 1 ELSE 0 END AS crank
  FROM memories
), relations AS (
  SELECT doc_id * 2 AS edge_id, doc_id AS source_id, t - t % 5 AS target_id,
         (['supersedes','related_to','caused_by','contradicts','parent_of','child_of'])[doc_id % 6 + 1] AS relation_type
  FROM (SELECT doc_id, (doc_id * 31 + 7) % (SELECT count(*) FROM documents) AS t FROM documents WHERE doc_id % 5 IN (1, 2, 3)) x WHERE doc_id <> t - t % 5
  UNION ALL
  SELECT doc_id * 2 + 1, doc_id, doc_id // 10 * 10 + 5, 'related_to' FROM documents
  WHERE doc_id % 3 = 0 AND doc_id % 5 <> 4 AND doc_id <> doc_id // 10 * 10 + 5 AND doc_id // 10 * 10 + 5 < (SELECT count(*) FROM documents)
), ends AS (
  SELECT source_id AS id, target_id AS other, relation_type, edge_id, 'out' AS direction FROM relations
  UNION ALL SELECT target_id, source_id, relation_type, edge_id, 'in' FROM relations
), degree AS (
  SELECT id, count(*) AS degree FROM ends GROUP BY id
), vectors AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings
)
"""
