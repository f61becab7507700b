"""Record types, value domains and default parameters.

A corpus is a set of DataFrames: ``memories`` (short typed records with a
namespace, a confidence and timestamps), ``relations`` (typed directed edges),
``access_log`` (append only), ``embeddings`` and ``claims``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The value domains.
MEMORY_TYPES = ("fact", "decision", "pattern", "bug", "architecture", "preference", "workflow", "context")
CONFIDENCE_RANK = {"verified": 3, "inferred": 2, "stale": 1, "deprecated": 0}
CONFIDENCE_WEIGHT = {"verified": 1.0, "inferred": 0.7, "stale": 0.3, "deprecated": 0.0}
RELATION_TYPES = ("supersedes", "related_to", "caused_by", "contradicts", "parent_of", "child_of")
LOW_SIGNAL = ("related_to",)
CLAIM_STATES = ("unverified", "open", "resolved")

# The defaults of scoring, search, context and graph operators.
WEIGHTS = {"relevance": 0.45, "freshness": 0.10, "access": 0.10, "confidence": 0.35}
DECAY, FRESHNESS_FLOOR, ACCESS_FULL = 0.01, 0.35, 50
DORMANT_DAYS, DEPRECATE_DAYS, REVIEW_DAYS, LOG_DAYS = 90, 180, 14, 90
RRF_K, COHORT, ENTRANTS, ENTRY_FLOOR = 60, 40, 5, 0.55
SPREAD_PER_SEED, SPREAD_TOTAL, OVER_CAP = 3, 10, 3
PIN_CAP, CONTEXT_LIMIT, TASK_SHARE, RECENT_SHARE, CROSS_QUOTA, TYPE_BOOST = 20, 10, 0.5, 0.3, 3, 0.1
DEDUPE_COSINE, DEDUPE_JACCARD, RELATE_COSINE, RELATE_JACCARD = 0.80, 0.15, 0.72, 0.10
CLUSTER_SIMILARITY, CLUSTER_LIMIT = 0.90, 10
HINTS, HINT_POOL = 3, 2
#: Rows that a side may hold to be marked for broadcast.
BROADCAST_ROWS = 50_000

MEMORIES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("namespace", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("last_accessed", T.TimestampType()),
        T.StructField("last_confirmed", T.TimestampType()),
        T.StructField("access_count", T.LongType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("pinned", T.BooleanType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)
RELATIONS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("source_id", T.StringType()),
        T.StructField("target_id", T.StringType()),
        T.StructField("relation_type", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("metadata", T.StringType()),
    ]
)
NAMESPACES = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("name", T.StringType()), T.StructField("path", T.StringType()), T.StructField("description", T.StringType())])
EXPORT = T.StructType([T.StructField("format_version", T.IntegerType()), T.StructField("exported_at", T.StringType()), T.StructField("namespaces", T.ArrayType(NAMESPACES)), T.StructField("memories", T.ArrayType(MEMORIES)), T.StructField("relations", T.ArrayType(RELATIONS))])
