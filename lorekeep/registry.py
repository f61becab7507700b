"""The registered queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import schema as S
from lorekeep.functions import scoring as sc
from lorekeep.functions import text as tx
from lorekeep.operators import claims, cluster, context, filters, graph, hints, listing, namespaces, postings, promote, repair, replay, review, search, setjoin, state, stats
from lorekeep.plans import benchmark, evaluate
from lorekeep.sources import portability, views
from lorekeep.sources.tables import new_path, saved
from lorekeep.sources.views import SQL, memories, now, relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The query text and vector of the search queries, and their entry floor.
QUERY, QUERY_ID, FLOOR = "the thand ertion reanon", 3, 0.2
TERMS = ("the", "thand", "ertion", "reanon")


def query(sql: str | None = None, plain: bool = False):
    """Register a query under its name, with SQL over the derived views (or the tables, if ``plain``)."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql if plain else SQL + sql
        return f

    return register


def vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector: that of one fixed id."""
    return list(views.embeddings(spark, sf_dir).where(F.col("id") == QUERY_ID).first()["vector"])


# filters and listings


@query("SELECT id, round(0.45*0.5 + 0.10*fresh + 0.10*access + 0.35*trust, 6) AS score FROM scored WHERE confidence <> 'deprecated' ORDER BY 0.45*0.5 + 0.10*fresh + 0.10*access + 0.35*trust DESC, id LIMIT 10")
def list_by_score(spark, sf_dir):
    df = listing.by_score(filters.select_memories(memories(spark, sf_dir)), 10, now())
    return df.select("id", F.round("score", 6).alias("score"))


@query("SELECT id, epoch_us(created_at) // 1000000 AS created FROM memories WHERE confidence <> 'deprecated' ORDER BY created_at DESC, id LIMIT 20")
def list_by_created(spark, sf_dir):
    df = listing.by_column(filters.select_memories(memories(spark, sf_dir)), "created", 20, now())
    return df.select("id", F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("created_at")).alias("created"))


@query("SELECT id, epoch_us(last_accessed) // 1000000 AS accessed FROM memories WHERE confidence <> 'deprecated' ORDER BY last_accessed DESC, id LIMIT 20")
def list_by_accessed(spark, sf_dir):
    df = listing.by_column(filters.select_memories(memories(spark, sf_dir)), "accessed", 20, now())
    return df.select("id", F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("last_accessed")).alias("accessed"))


@query("SELECT id, namespace, type, confidence FROM scored WHERE namespace IN ('src1','src2','src3') AND crank >= 2 AND created_at >= TIMESTAMP '2024-01-02' AND created_at <= TIMESTAMP '2024-01-20' AND list_contains(tags, 'en')")
def filter_composed(spark, sf_dir):
    df = filters.select_memories(memories(spark, sf_dir), ["src1", "src2", "src3"], None, "inferred", False, "2024-01-02", "2024-01-20", [" EN "])
    return df.select("id", "namespace", "type", "confidence")


@query("SELECT id FROM memories WHERE list_contains(tags, 'fr') AND list_contains(tags, 'long')")
def filter_all_tags(spark, sf_dir):
    return filters.with_all_tags(memories(spark, sf_dir), ["FR", "long", "fr"]).select("id")


@query("SELECT confidence, count(*) AS n FROM scored WHERE crank >= 2 GROUP BY confidence")
def min_confidence(spark, sf_dir):
    return stats.by(filters.at_least(memories(spark, sf_dir), "inferred"), "confidence")


@query("SELECT id FROM memories WHERE contains(lower(title || ' ' || content || ' ' || array_to_string(tags, ' ')), 'worthless') AND type IN ('fact', 'bug')")
def filter_text(spark, sf_dir):
    return filters.containing(memories(spark, sf_dir), "Worthless", ["fact", "bug"]).select("id")


@query("SELECT a.id, a.position FROM (VALUES (42,0),(7,1),(99,2),(13,3)) a(id, position) JOIN memories m ON m.id = a.id")
def fetch_by_ids_ordered(spark, sf_dir):
    return listing.by_ids(spark, memories(spark, sf_dir), [42, 7, 99, 13, 7, -5])[0].select("id", "position")


@query("SELECT CAST(a.id AS BIGINT) AS id, a.position FROM (VALUES (42,0),(-5,1),(1000000007,2)) a(id, position) ANTI JOIN memories m ON m.id = a.id")
def missing_ids(spark, sf_dir):
    return listing.by_ids(spark, memories(spark, sf_dir), [42, -5, 1_000_000_007])[1]


@query("SELECT edge_id, source_id, target_id FROM relations ORDER BY source_id, edge_id LIMIT 25 OFFSET 50")
def edges_page(spark, sf_dir):
    return listing.paged(relations(spark, sf_dir), [F.col("source_id"), F.col("edge_id")], 50, 25).select("edge_id", "source_id", "target_id")


# scores and labels


@query("SELECT id, round(age_days, 6) AS age_days, round(fresh, 6) AS freshness, round(access, 6) AS access, trust AS confidence, round(0.45*0.5 + 0.10*fresh + 0.10*access + 0.35*trust, 6) AS score FROM scored")
def score_components(spark, sf_dir):
    days = sc.days_between(sc.reference_time(), now())
    r = lambda c, n: F.round(c, 6).alias(n)
    return memories(spark, sf_dir).select("id", r(days, "age_days"), r(sc.freshness(days), "freshness"), r(sc.access_score("access_count"), "access"), sc.confidence_score().alias("confidence"), r(sc.composite(F.lit(0.5), now()), "score"))


_AGE = """CASE WHEN {d} * 1440.0 < 2 THEN 'just now' WHEN floor({d} * 1440.0) < 60 THEN CAST(floor({d} * 1440.0) AS BIGINT) || ' minutes ago'
 WHEN floor({d} * 24.0) < 24 THEN CAST(floor({d} * 24.0) AS BIGINT) || CASE WHEN floor({d} * 24.0) = 1 THEN ' hour ago' ELSE ' hours ago' END
 WHEN {d} < 7 THEN CAST(floor({d}) AS BIGINT) || CASE WHEN floor({d}) = 1 THEN ' day ago' ELSE ' days ago' END
 WHEN {d} < 60 THEN CAST(floor({d} / 7) AS BIGINT) || CASE WHEN floor({d} / 7) = 1 THEN ' week ago' ELSE ' weeks ago' END
 WHEN {d} < 365 THEN CAST(floor({d} / 30) AS BIGINT) || CASE WHEN floor({d} / 30) = 1 THEN ' month ago' ELSE ' months ago' END
 ELSE CAST(floor({d} / 365) AS BIGINT) || CASE WHEN floor({d} / 365) = 1 THEN ' year ago' ELSE ' years ago' END END"""


@query(f"""SELECT id, CASE WHEN anchor > created_at AND base <> upd THEN base || ' (updated ' || upd || ')' ELSE base END AS label FROM (
 SELECT id, anchor, created_at, {_AGE.format(d="c")} AS base, {_AGE.format(d="age_days")} AS upd FROM (SELECT *, greatest(0, epoch_us(TIMESTAMP '2024-02-15') - epoch_us(created_at)) / 86400000000.0 AS c FROM scored) y) x""")
def age_labels(spark, sf_dir):
    return memories(spark, sf_dir).select("id", sc.age_label(now()).alias("label"))


@query("SELECT id, length(title) + length(content) AS chars, (length(title) + length(content)) // 4 AS tokens FROM memories")
def token_estimates(spark, sf_dir):
    return memories(spark, sf_dir).select("id", (F.length("title") + F.length("content")).cast("long").alias("chars"), tx.estimated_tokens(F.col("title"), F.col("content")).cast("long").alias("tokens"))


# search

_WORDS = r"""
, toks AS (
  SELECT id, list_filter(regexp_split_to_array(lower(title || ' ' || content), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM memories
), st AS (
  SELECT count(*) AS n, avg(len(w)) AS avgdl FROM toks
), tf AS (
  SELECT id, len(w) AS dl, t.term, len(list_filter(w, lambda x: x = t.term)) AS tf FROM toks, (SELECT unnest(['the','thand','ertion','reanon']) AS term) t
), df AS (
  SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term
), bm AS (
  SELECT id, sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25
  FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY id
)
"""
_FUSED = (
    _WORDS
    + """
, pool AS (
  SELECT id, row_number() OVER (ORDER BY round(bm25, 9) DESC, id) AS br FROM bm JOIN memories USING (id) WHERE confidence <> 'deprecated' QUALIFY br <= 40
), sim AS (
  SELECT v.id, list_cosine_similarity(v.vector, q.vector) AS s FROM vectors v JOIN memories m ON m.id = v.id AND m.confidence <> 'deprecated', (SELECT vector FROM vectors WHERE id = 3) q
), cand AS (
  SELECT id, s FROM sim SEMI JOIN pool USING (id)
  UNION ALL (SELECT id, s FROM sim ANTI JOIN pool USING (id) WHERE s >= 0.2 ORDER BY s DESC, id LIMIT 5)
), sem AS (
  SELECT id, row_number() OVER (ORDER BY s DESC, id) AS sr FROM cand
), fused AS (
  SELECT id, least(1.0, (coalesce(1.0 / (60 + br), 0) + coalesce(1.0 / (60 + sr), 0)) / (2.0 / 61)) AS relevance FROM pool FULL JOIN sem USING (id)
)
"""
)


@query(_WORDS + "SELECT id, round(bm25, 6) AS bm25 FROM bm ORDER BY round(bm25, 9) DESC, id LIMIT 25")
def bm25_topk(spark, sf_dir):
    df = search.bm25(memories(spark, sf_dir), QUERY)
    return df.orderBy(F.round("bm25", 9).desc(), "id").limit(25).select("id", F.round("bm25", 6).alias("bm25"))


@query()
def bm25_stemmed(spark, sf_dir):
    df = search.bm25(memories(spark, sf_dir), QUERY, stemmed=True)
    return df.orderBy(F.desc("bm25"), "id").limit(25).select("id", F.round("bm25", 6).alias("bm25"))


@query(_WORDS + "SELECT id FROM bm JOIN memories USING (id) WHERE confidence <> 'deprecated' ORDER BY created_at DESC, id LIMIT 15")
def match_ordered_by(spark, sf_dir):
    df = memories(spark, sf_dir)
    return search.matches_by(df, filters.select_memories(df), QUERY, "created_at", 15).select("id")


@query("SELECT v.id, round(list_cosine_similarity(v.vector, q.vector), 6) AS similarity FROM vectors v, (SELECT vector FROM vectors WHERE id = 3) q ORDER BY list_cosine_similarity(v.vector, q.vector) DESC, v.id LIMIT 20")
def vector_topk(spark, sf_dir):
    return search.vector_topk(views.embeddings(spark, sf_dir), vector(spark, sf_dir), 20).select("id", F.round("similarity", 6).alias("similarity"))


@query(_FUSED + "SELECT id, round(relevance, 6) AS relevance FROM fused")
def hybrid_rrf(spark, sf_dir):
    df = memories(spark, sf_dir)
    found = search.fused(df, filters.select_memories(df), views.embeddings(spark, sf_dir), QUERY, vector(spark, sf_dir), 10, FLOOR)
    return found.select("id", F.round("relevance", 6).alias("relevance"))


@query(_FUSED + "SELECT id, round(0.45*relevance + 0.10*fresh + 0.10*access + 0.35*trust, 6) AS score FROM fused JOIN scored USING (id) ORDER BY 0.45*relevance + 0.10*fresh + 0.10*access + 0.35*trust DESC, id LIMIT 10")
def hybrid_composite(spark, sf_dir):
    df = memories(spark, sf_dir)
    found = search.hybrid(df, filters.select_memories(df), views.embeddings(spark, sf_dir), QUERY, vector(spark, sf_dir), now(), 10, S.WEIGHTS, FLOOR)
    return found.select("id", F.round("score", 6).alias("score"))


# counts and health


@query("""SELECT count(*) AS total, count(*) FILTER (confidence <> 'deprecated') AS active,
 count(*) FILTER (confidence <> 'deprecated' AND epoch_us(TIMESTAMP '2024-02-15') - epoch_us(last_accessed) >= 20 * 86400000000) AS dormant,
 count(*) FILTER (confidence <> 'deprecated' AND epoch_us(TIMESTAMP '2024-02-15') - epoch_us(last_confirmed) >= 30 * 86400000000) AS suggested,
 count(*) FILTER (pinned AND confidence <> 'deprecated') AS pinned FROM memories""")
def stats_counts(spark, sf_dir):
    return stats.counts(memories(spark, sf_dir), now(), 20, 30)


@query("SELECT type, count(*) AS n FROM memories GROUP BY type")
def stats_by_type(spark, sf_dir):
    return stats.by(memories(spark, sf_dir), "type")


@query("SELECT namespace, confidence, count(*) AS n FROM memories GROUP BY ALL")
def stats_by_confidence(spark, sf_dir):
    return stats.by(memories(spark, sf_dir), "namespace", "confidence")


def _namespaces(spark, sf_dir):
    """Every source, and as many names that hold nothing."""
    own = views.table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    return own.union(own.select(F.concat("name", F.lit("-old"))))


_NAMES = ", names AS (SELECT DISTINCT source AS name FROM documents UNION ALL SELECT DISTINCT source || '-old' FROM documents) "


@query(_NAMES + "SELECT name, count(m.id) AS n FROM names LEFT JOIN memories m ON m.namespace = name GROUP BY name")
def namespace_counts(spark, sf_dir):
    return stats.namespace_counts(_namespaces(spark, sf_dir), memories(spark, sf_dir))


@query(_NAMES + "SELECT name FROM names ANTI JOIN memories m ON m.namespace = name")
def ghost_namespaces(spark, sf_dir):
    return stats.ghosts(_namespaces(spark, sf_dir), memories(spark, sf_dir))


@query("SELECT namespace, title, count(*) AS n, array_to_string(list_sort(list(id)), ',') AS ids FROM memories GROUP BY namespace, title HAVING count(*) > 1")
def duplicate_titles(spark, sf_dir):
    df = cluster.title_clusters(memories(spark, sf_dir))
    return df.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("SELECT namespace, count(*) AS pins, count(*) >= 20 AS \"full\" FROM memories WHERE pinned AND confidence <> 'deprecated' GROUP BY namespace")
def pin_counts(spark, sf_dir):
    return stats.pins(memories(spark, sf_dir))


@query("SELECT unnest(tags) AS tag, count(*) AS n FROM memories GROUP BY 1")
def tag_frequency(spark, sf_dir):
    return stats.tag_counts(memories(spark, sf_dir))


@query("SELECT strftime(created_at, '%Y-%m-%d') AS bucket, count(*) AS n FROM memories GROUP BY 1")
def timeline_day(spark, sf_dir):
    return stats.timeline(memories(spark, sf_dir), "day")


@query("SELECT strftime(created_at, '%G-W%V') AS bucket, count(*) AS n FROM memories GROUP BY 1")
def timeline_week(spark, sf_dir):
    return stats.timeline(memories(spark, sf_dir), "week")


@query("SELECT strftime(updated_at, '%Y-%m') AS bucket, count(*) AS n FROM memories GROUP BY 1")
def timeline_month(spark, sf_dir):
    return stats.timeline(memories(spark, sf_dir), "month", "updated_at")


@query("SELECT strftime(created_at, '%G-W%V') AS bucket, " + ", ".join(f"count(*) FILTER (type = '{t}') AS {t}" for t in S.MEMORY_TYPES) + " FROM memories GROUP BY 1")
def stacked_by_type(spark, sf_dir):
    return stats.stacked_by_type(memories(spark, sf_dir))


@query("SELECT strftime(last_accessed, '%Y-%m-%d') AS bucket, count(*) AS n FROM memories GROUP BY 1")
def activity_series(spark, sf_dir):
    return stats.activity(memories(spark, sf_dir))


@query("""SELECT strftime(min(created_at), '%Y-%m-%d') AS first_day, strftime(max(created_at), '%Y-%m-%d') AS last_day,
 greatest(1, CAST(round((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 86400000000.0) AS BIGINT)) AS days,
 round(count(*) / greatest(1, CAST(round((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 86400000000.0) AS BIGINT)), 2) AS per_day FROM memories""")
def corpus_span(spark, sf_dir):
    return stats.span(memories(spark, sf_dir))


@query("""SELECT count(*) FILTER (h >= 0.7) AS healthy, count(*) FILTER (h >= 0.4 AND h < 0.7) AS fading, count(*) FILTER (h < 0.4) AS stale,
 count(*) FILTER (epoch_us(TIMESTAMP '2024-02-15') - epoch_us(last_accessed) >= 20 * 86400000000) AS dormant
 FROM (SELECT *, (0.1 * (0.35 + 0.65 * exp(-0.01 * greatest(0, epoch_us(TIMESTAMP '2024-02-15') - epoch_us(coalesce(last_confirmed, updated_at, created_at))) / 86400000000.0)) + 0.1 * access + 0.35 * trust) / 0.55 AS h FROM scored) x""")
def health_summary(spark, sf_dir):
    return stats.health_summary(memories(spark, sf_dir), now(), 20)


@query("SELECT (SELECT count(*) FROM memories) AS memories, (SELECT count(*) FROM memories WHERE confidence = 'verified') AS verified, (SELECT count(DISTINCT namespace) FROM memories) AS namespaces, (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM memories) x) AS tags, (SELECT count(*) FROM relations) AS relations")
def stats_cards(spark, sf_dir):
    return stats.cards(memories(spark, sf_dir), relations(spark, sf_dir))


@query("SELECT id, greatest(3, least(12, 2 * len(tags) + access_count + 3)) AS size FROM memories")
def node_sizes(spark, sf_dir):
    return stats.node_sizes(memories(spark, sf_dir))


@query("SELECT context, count(*) AS n, count(DISTINCT memory_id) AS memories FROM access_log GROUP BY context")
def access_counts(spark, sf_dir):
    return stats.log_by_context(views.access_log(spark, sf_dir))


@query("SELECT context, count(*) AS n, count(DISTINCT memory_id) AS memories FROM access_log WHERE accessed_at >= TIMESTAMP '2024-01-16' GROUP BY context")
def access_retention(spark, sf_dir):
    return stats.log_by_context(stats.retained_log(views.access_log(spark, sf_dir), now(), 30))


# graph


@query("SELECT id, degree FROM degree")
def graph_degree(spark, sf_dir):
    return graph.degrees(relations(spark, sf_dir))


@query("""SELECT m AS memories, e AS edges, round(e / m, 2) AS edges_per_memory, hs AS high_signal, round(hs / e, 3) AS high_signal_ratio, m - l AS orphans, round((m - l) / m, 3) AS orphan_ratio, oc AS over_cap
 FROM (SELECT (SELECT count(*) FROM memories) AS m, (SELECT count(*) FROM relations) AS e, (SELECT count(*) FROM relations WHERE relation_type <> 'related_to') AS hs,
 (SELECT count(*) FROM degree SEMI JOIN memories USING (id)) AS l, (SELECT count(*) FROM degree SEMI JOIN memories USING (id) WHERE degree > 3) AS oc) x""")
def graph_metrics(spark, sf_dir):
    return graph.metrics(memories(spark, sf_dir), relations(spark, sf_dir))


@query("SELECT id, namespace FROM memories ANTI JOIN degree USING (id)")
def orphans(spark, sf_dir):
    return filters.orphans(memories(spark, sf_dir), relations(spark, sf_dir)).select("id", "namespace")


@query("SELECT id FROM scored ANTI JOIN degree USING (id) ORDER BY crank DESC, access_count DESC, anchor DESC, id LIMIT 5")
def orphan_sample(spark, sf_dir):
    return graph.orphan_sample(filters.orphans(memories(spark, sf_dir), relations(spark, sf_dir)), 5).select("id")


@query("SELECT relation_type, count(*) AS n FROM relations GROUP BY 1")
def edges_by_type(spark, sf_dir):
    return stats.by(relations(spark, sf_dir), "relation_type")


@query("""SELECT r.edge_id, r.source_id, r.target_id, r.relation_type, s.title AS source_title, t.title AS target_title, s.namespace AS source_namespace, t.namespace AS target_namespace, sd.degree AS source_degree, td.degree AS target_degree
 FROM relations r JOIN memories s ON s.id = source_id JOIN memories t ON t.id = target_id JOIN degree sd ON sd.id = source_id JOIN degree td ON td.id = target_id
 WHERE (s.namespace = 'src5' OR t.namespace = 'src5') AND relation_type <> 'supersedes'""")
def list_edges(spark, sf_dir):
    return graph.list_edges(memories(spark, sf_dir), relations(spark, sf_dir), "src5").where("relation_type <> 'supersedes'")


@query("SELECT id, other, relation_type, direction FROM ends")
def edge_direction(spark, sf_dir):
    return graph.endpoints(relations(spark, sf_dir)).select("id", "other", "relation_type", "direction")


@query("""SELECT edge_id, r.source_id, r.target_id, CASE WHEN relation_type = 'caused_by' THEN 'related_to' ELSE relation_type END AS relation_type,
 CASE WHEN relation_type <> 'caused_by' THEN 'unchanged' WHEN x.source_id IS NOT NULL THEN 'merged' ELSE 'retyped' END AS outcome
 FROM relations r LEFT JOIN (SELECT DISTINCT source_id, target_id FROM relations WHERE relation_type = 'related_to') x ON x.source_id = r.source_id AND x.target_id = r.target_id""")
def retype_merge(spark, sf_dir):
    return graph.retyped(relations(spark, sf_dir), "caused_by", "related_to")


@query("""SELECT edge_id, r.target_id AS source_id, r.source_id AS target_id, relation_type, CASE WHEN x.source_id IS NOT NULL THEN 'merged' ELSE 'reversed' END AS outcome
 FROM relations r LEFT JOIN (SELECT DISTINCT source_id, target_id FROM relations WHERE relation_type = 'related_to') x ON x.source_id = r.target_id AND x.target_id = r.source_id WHERE relation_type = 'related_to'""")
def reverse_merge(spark, sf_dir):
    return graph.reversed_edges(relations(spark, sf_dir), "related_to")


@query("""SELECT seed, place, id FROM (SELECT e.id AS seed, s.id, row_number() OVER (PARTITION BY e.id ORDER BY crank DESC, d.degree, anchor DESC, s.id DESC) AS place
 FROM (SELECT DISTINCT id, other FROM ends WHERE id <> other) e JOIN scored s ON s.id = e.other JOIN degree d ON d.id = e.other) x WHERE place <= 3""")
def dampened_neighbours(spark, sf_dir):
    return graph.one_seed_neighbours(memories(spark, sf_dir), relations(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


# Picks for each question, one seed after the other.
_SPREAD = """
, near AS (
  SELECT e.id AS seed, list(s.id ORDER BY crank DESC, d.degree, anchor DESC, s.id DESC) AS cands
  FROM (SELECT DISTINCT id, other FROM ends) e JOIN scored s ON s.id = e.other JOIN degree d ON d.id = e.other GROUP BY e.id
), own AS (
  SELECT question, place, coalesce(cands, []) AS cands FROM seeds LEFT JOIN near ON seed = id
), start AS (
  SELECT question, list(id) AS seen FROM seeds GROUP BY question
), picks AS (
  WITH RECURSIVE r(question, i, seen, got) AS (
    SELECT question, 0, seen, CAST([] AS BIGINT[]) FROM start
    UNION ALL
    SELECT question, i + 1, list_concat(seen, take), list_concat(got, take) FROM (
      SELECT r.*, list_slice(list_filter(c.cands, lambda x: NOT list_contains(r.seen, x)), 1, least(3, 10 - len(r.got))) AS take FROM r JOIN own c ON c.question = r.question AND c.place = r.i + 1
    ) x
  ) SELECT question, got FROM r QUALIFY row_number() OVER (PARTITION BY question ORDER BY i DESC) = 1
)
"""


@query(_FUSED + """, seeds AS (
  SELECT 0 AS question, row_number() OVER (ORDER BY 0.45*relevance + 0.10*fresh + 0.10*access + 0.35*trust DESC, id) AS place, id FROM fused JOIN scored USING (id) QUALIFY place <= 10
)""" + _SPREAD + "SELECT p.position, m.id, title, confidence FROM (SELECT unnest(got) AS id, CAST(unnest(range(len(got))) AS INTEGER) AS position FROM picks) p JOIN memories m USING (id)")
def spread_from_search(spark, sf_dir):
    """The dampened neighbours of the ten best search results, in order."""
    df, edges = memories(spark, sf_dir), relations(spark, sf_dir)
    top = search.hybrid(df, filters.select_memories(df), views.embeddings(spark, sf_dir), QUERY, vector(spark, sf_dir), now(), 10, S.WEIGHTS, FLOOR)
    seeds = search.ranked(saved(top.select("id", "score"), "top"), [F.desc("score"), F.col("id")], "place").select(F.lit(0).alias("question"), "place", "id")
    return graph.spread(df, edges, seeds).join(df.select("id", "title", "confidence"), "id").select("position", "id", "title", "confidence")


@query(", seeds AS (SELECT id // 10 AS question, id % 10 + 1 AS place, id FROM memories)" + _SPREAD + "SELECT question, unnest(got) AS id, CAST(unnest(range(len(got))) AS INTEGER) AS position FROM picks")
def spread_many(spark, sf_dir):
    """The dampened neighbours of all memories in tens: as many questions as that makes, each with ten seeds in order."""
    df = memories(spark, sf_dir)
    seeds = df.select(F.floor(F.col("id") / 10).alias("question"), (F.col("id") % 10 + 1).alias("place"), "id")
    return graph.spread(df, relations(spark, sf_dir), seeds)


@query("""SELECT least(x.class, y.class) AS a, greatest(x.class, y.class) AS b, len(list_intersect(x.tags, y.tags)) AS shared, count(*) AS pairs
 FROM (SELECT id, tags, min(id) OVER (PARTITION BY list_sort(tags)) AS class FROM memories) x JOIN (SELECT id, tags, min(id) OVER (PARTITION BY list_sort(tags)) AS class FROM memories) y ON x.id < y.id
 WHERE len(list_intersect(x.tags, y.tags)) >= 2 GROUP BY ALL""")
def shared_tag_links(spark, sf_dir):
    """The shared-tag links of all memories, between classes of equal tags; ``shared_tag_classes`` has the members, too."""
    links = graph.class_links(graph.tag_classes(memories(spark, sf_dir)))
    return links.select("a", "b", F.col("shared").cast("long").alias("shared"), "pairs")


@query("""SELECT 'link' AS kind, least(x.class, y.class) AS a, greatest(x.class, y.class) AS b, len(list_intersect(x.tags, y.tags)) AS shared, count(*) AS pairs
 FROM (SELECT id, tags, min(id) OVER (PARTITION BY list_sort(tags)) AS class FROM memories) x JOIN (SELECT id, tags, min(id) OVER (PARTITION BY list_sort(tags)) AS class FROM memories) y ON x.id < y.id
 WHERE len(list_intersect(x.tags, y.tags)) >= 2 GROUP BY ALL
 UNION ALL SELECT 'member', min(id) OVER (PARTITION BY list_sort(tags)), id, len(tags), 0 FROM memories""")
def shared_tag_classes(spark, sf_dir):
    """The shared-tag links of all memories: each memory's class of equal tags (a: class, b: memory), and the links between classes."""
    classes = graph.tag_classes(memories(spark, sf_dir))
    links = graph.class_links(classes).select(F.lit("link").alias("kind"), "a", "b", F.col("shared").cast("long").alias("shared"), "pairs")
    return links.union(classes.select(F.lit("member"), "class", "id", F.size("tags").cast("long"), F.lit(0).cast("long")))


@query("SELECT edge_id, source_id, target_id FROM relations SEMI JOIN (SELECT id FROM memories WHERE confidence = 'verified') x ON x.id = source_id SEMI JOIN (SELECT id FROM memories WHERE confidence = 'verified') y ON y.id = target_id")
def induced_subgraph(spark, sf_dir):
    return graph.induced(relations(spark, sf_dir), memories(spark, sf_dir).where("confidence = 'verified'")).select("edge_id", "source_id", "target_id")


@query("SELECT id, array_to_string(list_sort(list(DISTINCT other)), ',') AS neighbours FROM ends GROUP BY id")
def adjacency(spark, sf_dir):
    return graph.adjacency(relations(spark, sf_dir)).withColumn("neighbours", F.array_join(F.col("neighbours").cast("array<string>"), ","))


# similarity and clusters


@query("SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.vector, b.vector), 6) AS similarity FROM vectors a JOIN vectors b ON a.id < b.id WHERE list_cosine_similarity(a.vector, b.vector) >= 0.35")
def near_dup_pairs(spark, sf_dir):
    return cluster.similar_pairs(views.embeddings(spark, sf_dir), 0.35).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("""SELECT id, cluster FROM (WITH RECURSIVE p AS (SELECT a.id AS a, b.id AS b FROM vectors a JOIN vectors b ON a.id <> b.id WHERE list_cosine_similarity(a.vector, b.vector) >= 0.42),
 r(id, root) AS (SELECT DISTINCT a, a FROM p UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id) SELECT id, min(root) AS cluster FROM r GROUP BY id) x""")
def near_dup_clusters(spark, sf_dir):
    return cluster.connected(cluster.similar_links(views.embeddings(spark, sf_dir), 0.42), new_path(spark, "clusters"))


_TOKENS = r"""list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 3))"""


@query(f"""SELECT id, round(s, 4) AS similarity FROM (SELECT m.id, len(list_intersect({_TOKENS.format("m.title || ' ' || m.content")}, q.t)) / len(list_distinct(list_concat({_TOKENS.format("m.title || ' ' || m.content")}, q.t))) AS s
 FROM memories m, (SELECT {_TOKENS.format("title || ' ' || content")} AS t FROM memories WHERE id = 10) q WHERE m.id <> 10) x WHERE s >= 0.05 ORDER BY round(s, 4) DESC, id LIMIT 10""")
def dedupe_gate(spark, sf_dir):
    df = memories(spark, sf_dir)
    one = df.where("id = 10").first()
    found = cluster.similar_to(df.where("id <> 10"), None, f"{one['title']} {one['content']}", None, (0.0, 0.05), 10)
    return found.select("id", "similarity")


@query("SELECT v.id, round(list_cosine_similarity(v.vector, q.vector), 4) AS similarity FROM vectors v JOIN memories m ON m.id = v.id, (SELECT vector FROM vectors WHERE id = 3) q WHERE list_cosine_similarity(v.vector, q.vector) >= 0.25 AND v.id <> 3 ORDER BY 2 DESC, 1 LIMIT 10")
def relation_gate(spark, sf_dir):
    df = memories(spark, sf_dir).where("id <> 3")
    found = cluster.similar_to(df, views.embeddings(spark, sf_dir), "", vector(spark, sf_dir), (0.25, 0.0), 10)
    return found.select("id", "similarity")


@query(f"""
, ws AS (
  SELECT id, list_sort({_TOKENS.format("title || ' ' || content")}) AS w FROM memories
), cl AS (
  SELECT id, w, min(id) OVER (PARTITION BY w) AS class FROM ws WHERE len(w) > 0
), tk AS (
  SELECT id, len(w) AS n, unnest(w) AS t FROM cl WHERE id = class
), ov AS (
  SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS o FROM tk a JOIN tk b ON a.t = b.t AND a.id < b.id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) GROUP BY ALL
)
SELECT 'link' AS kind, a, b, round(o / (na + nb - o), 6) AS similarity FROM ov WHERE o / (na + nb - o) >= 0.8
UNION ALL SELECT 'member', class, id, 1.0 FROM cl""")
def jaccard_join(spark, sf_dir):
    """All memories of similar sets of words: links between classes of equal sets, and each memory's class (a: class, b: memory)."""
    links, classes = setjoin.jaccard_links(views.texts(spark, sf_dir), 0.8)
    return links.select(F.lit("link").alias("kind"), "a", "b", F.round("similarity", 6).alias("similarity")).union(classes.select(F.lit("member"), "class", "id", F.lit(1.0)))


@query(f"""
, ws AS (
  SELECT id, {_TOKENS.format("title || ' ' || content")} AS w FROM memories
)
SELECT 'cosine' AS measure, source_id AS a, target_id AS b, round(list_cosine_similarity(x.vector, y.vector), 6) AS similarity FROM (SELECT DISTINCT source_id, target_id FROM relations) r JOIN vectors x ON x.id = source_id JOIN vectors y ON y.id = target_id
UNION ALL SELECT 'lexical', source_id, target_id, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 6) FROM (SELECT DISTINCT source_id, target_id FROM relations) r JOIN ws x ON x.id = source_id JOIN ws y ON y.id = target_id""")
def pair_similarity(spark, sf_dir):
    """How alike the ends of every edge are, by vectors and by words."""
    df = memories(spark, sf_dir)
    pairs = saved(relations(spark, sf_dir).select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct(), "pairs")
    out = None
    for vectors in (views.embeddings(spark, sf_dir), None):
        found, measure = setjoin.pair_similarity(pairs, df, vectors)
        found = found.select(F.lit(measure).alias("measure"), "a", "b", F.round("similarity", 6).alias("similarity"))
        out = found if out is None else out.union(found)
    return out


def _titled(df):
    """Clusters by namespace and title."""
    return df.withColumn("cluster", F.concat_ws("|", "namespace", "title"))


_CLUSTERED = ", c AS (SELECT *, namespace || '|' || title AS cluster  FROM scored) "
_KIND = ", k AS (SELECT cluster, arg_max(type, (k, -f)) AS type FROM (SELECT cluster, type, count(*) AS k, min(id) AS f FROM c GROUP BY ALL) x GROUP BY cluster) "


@query(_CLUSTERED + _KIND + """SELECT cluster, count(*) AS n, '[merge] ' || arg_min(title, id) AS title, md5(string_agg('## ' || title || chr(10) || content, chr(10) || chr(10) ORDER BY id)) AS content_md5,
 arg_max(confidence, crank) AS confidence, any_value(k.type) AS type, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags FROM c JOIN k USING (cluster) GROUP BY cluster HAVING count(*) > 1""")
def consolidate_merge(spark, sf_dir):
    df = cluster.consolidated(_titled(memories(spark, sf_dir)), "cluster", "merge")
    return df.select("cluster", "n", "title", F.md5("content").alias("content_md5"), "confidence", "type", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query("SELECT namespace || '|' || title AS cluster, count(*) AS n, arg_max(id, (crank, updated_at, -id)) AS kept FROM scored GROUP BY 1 HAVING count(*) > 1")
def consolidate_dedupe(spark, sf_dir):
    return cluster.consolidated(_titled(memories(spark, sf_dir)), "cluster", "deduplicate").select("cluster", "n", "kept")


@query(_CLUSTERED + _KIND + """SELECT cluster, count(*) AS n, '[summarize] ' || arg_min(title, id) AS title, 'Summary of ' || count(*) || ' memories:' || chr(10) || string_agg('- ' || title || ': ' || replace(substr(content, 1, 160), chr(10), ' ') || CASE WHEN length(content) > 160 THEN '…' ELSE '' END, chr(10) ORDER BY id) AS content,
 any_value(k.type) AS type FROM c JOIN k USING (cluster) GROUP BY cluster HAVING count(*) > 1""")
def consolidate_summarize(spark, sf_dir):
    return cluster.consolidated(_titled(memories(spark, sf_dir)), "cluster", "summarize").select("cluster", "n", "title", "content", "type")


# context


@query("""SELECT 'pinned' AS bucket, id FROM (SELECT id FROM memories WHERE namespace = 'src0' AND pinned AND confidence <> 'deprecated' ORDER BY coalesce(last_confirmed, created_at) DESC, id LIMIT 20)
 UNION ALL SELECT 'recent', id FROM (SELECT id FROM memories WHERE namespace = 'src0' AND NOT pinned AND confidence <> 'deprecated' ORDER BY last_accessed DESC, id LIMIT 10)
 UNION ALL SELECT 'cross', id FROM (SELECT id FROM memories WHERE namespace <> 'src0' AND type IN ('pattern','preference') AND confidence = 'verified' ORDER BY access_count DESC, id LIMIT 3)""")
def context_buckets(spark, sf_dir):
    df = memories(spark, sf_dir)
    own = df.where("namespace = 'src0'")
    parts = (("pinned", context.pinned_bucket(own)), ("recent", context.recent_bucket(own, 10)), ("cross", context.cross_bucket(df, "src0")))
    rows = [part.select(F.lit(name).alias("bucket"), "id") for name, part in parts]
    return rows[0].union(rows[1]).union(rows[2])


def _task(spark, sf_dir, df, namespace):
    own = filters.select_memories(df, [namespace])
    return search.hybrid(df, own, views.embeddings(spark, sf_dir), QUERY, vector(spark, sf_dir), now(), 5, S.WEIGHTS, FLOOR).select("id", "score")


_CONTEXT = """
, sc AS (
  SELECT *, 0.45*0.5 + 0.10*fresh + 0.10*access + 0.35*trust + CASE WHEN type IN ('architecture', 'decision') THEN 0.1 ELSE 0 END AS base FROM scored WHERE confidence <> 'deprecated'
), pins AS (
  SELECT ns, id, row_number() OVER (PARTITION BY ns ORDER BY coalesce(last_confirmed, created_at) DESC, id) AS place FROM sess JOIN sc ON namespace = ns WHERE pinned QUALIFY place <= 20
), recent AS (
  SELECT ns, id, epoch_us(last_accessed) // 1000000 AS signal, base AS score FROM sess JOIN sc ON namespace = ns WHERE NOT pinned QUALIFY row_number() OVER (PARTITION BY ns ORDER BY last_accessed DESC, id) <= 10
), cross_ AS (
  SELECT ns, id, access_count AS signal, base AS score FROM sess JOIN sc ON namespace <> ns WHERE type IN ('pattern', 'preference') AND confidence = 'verified' QUALIFY row_number() OVER (PARTITION BY ns ORDER BY access_count DESC, id) <= 3
), offers AS (
  SELECT 0 AS turn, 'recent' AS bucket, * FROM recent UNION ALL SELECT 2, 'cross', * FROM cross_
  UNION ALL SELECT 1, 'task', ns, id, t.score, t.score + CASE WHEN type IN ('architecture', 'decision') THEN 0.1 ELSE 0 END FROM task t JOIN sc USING (id) WHERE NOT pinned
), b AS (
  SELECT *, max(score) OVER (PARTITION BY ns, id) AS best FROM offers ANTI JOIN pins USING (ns, id)
), p0 AS (
  SELECT *, row_number() OVER (PARTITION BY ns ORDER BY signal DESC, best DESC, id DESC) AS place FROM b WHERE turn = 0 QUALIFY place <= 3
), p1 AS (
  SELECT *, row_number() OVER (PARTITION BY ns ORDER BY signal DESC, best DESC, id DESC) AS place FROM b ANTI JOIN p0 USING (ns, id) WHERE turn = 1 QUALIFY place <= 5
), p2 AS (
  SELECT *, row_number() OVER (PARTITION BY ns ORDER BY signal DESC, best DESC, id DESC) AS place FROM b ANTI JOIN (SELECT ns, id FROM p0 UNION SELECT ns, id FROM p1) x USING (ns, id) WHERE turn = 2 QUALIFY place <= 3
), chosen AS (
  SELECT *, row_number() OVER (PARTITION BY ns ORDER BY turn, place) AS n FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2) x QUALIFY n <= 10
), rest AS (
  SELECT ns, id, row_number() OVER (PARTITION BY ns ORDER BY max(best) DESC, id) AS place FROM b ANTI JOIN chosen USING (ns, id) GROUP BY ns, id
), ctx AS (
  SELECT ns, id, bucket, CAST(row_number() OVER (PARTITION BY ns ORDER BY shown, place, id) AS INTEGER) AS position FROM (
    SELECT ns, id, 'pinned' AS bucket, 0 AS shown, place FROM pins
    UNION ALL SELECT ns, id, bucket, CASE bucket WHEN 'task' THEN 1 WHEN 'recent' THEN 2 ELSE 3 END, place FROM chosen
    UNION ALL SELECT r.ns, id, 'backfill', 4, place FROM rest r LEFT JOIN (SELECT ns, count(*) AS n FROM chosen GROUP BY ns) c ON c.ns = r.ns WHERE place <= 10 - coalesce(n, 0)
  ) x
)
"""
_NO_TASK = ", task AS (SELECT 'x' AS ns, 0 AS id, 0.0 AS score WHERE false)"


@query(_FUSED.replace("confidence <> 'deprecated'", "confidence <> 'deprecated' AND namespace = 'src0'") + """, sess AS (SELECT 'src0' AS ns), task AS (
  SELECT 'src0' AS ns, id, 0.45*relevance + 0.10*fresh + 0.10*access + 0.35*trust AS score FROM fused JOIN scored USING (id) ORDER BY score DESC, id LIMIT 5
)""" + _CONTEXT + "SELECT id, bucket, position FROM ctx")
def context_selected(spark, sf_dir):
    df = memories(spark, sf_dir)
    return context.selected(df.drop("content"), "src0", now(), _task(spark, sf_dir, df, "src0"))


@query(", sess AS (SELECT DISTINCT namespace AS ns FROM memories)" + _NO_TASK + _CONTEXT + "SELECT ns AS session, id, bucket, position FROM ctx")
def context_all(spark, sf_dir):
    """The contexts of all namespaces in one plan."""
    df = memories(spark, sf_dir).drop("content")
    return context.contexts(df, df.select(F.col("namespace").alias("session"), "namespace").distinct(), now())


@query(", sess AS (SELECT DISTINCT namespace AS ns FROM memories)" + _NO_TASK + _CONTEXT + """, m AS (
  SELECT CAST(substr(ns, 4) AS INT) // 2 AS grp, CAST(substr(ns, 4) AS INT) % 2 AS turn, *, CASE WHEN bucket = 'pinned' THEN 0 ELSE 1 END AS tail FROM ctx
), f AS (
  SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY grp, id ORDER BY tail, position, turn) = 1
)
SELECT grp AS "group", id, bucket, ns AS session, CAST(row_number() OVER (PARTITION BY grp ORDER BY tail, position, turn, id) AS INTEGER) AS place FROM f""")
def context_merged(spark, sf_dir):
    """The contexts of the namespaces in pairs (src0 and src1, src2 and src3, ...), merged."""
    df = memories(spark, sf_dir).drop("content")
    every = context.contexts(df, df.select(F.col("namespace").alias("session"), "namespace").distinct(), now())
    number = F.substring("session", 4, 9).cast("int")
    return context.merged(every.withColumns({"group": F.floor(number / 2).cast("int"), "turn": number % 2}))


# claims and review


@query("""SELECT id AS memory_id, namespace, 'pr' AS kind, namespace || '#' || (id % 50) AS ref, CASE id % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'open' ELSE 'unverified' END AS state FROM memories""")
def claims_extracted(spark, sf_dir):
    """Texts get their claim from their id, so the expected state follows from the id alone."""
    df = views.claim_texts(spark, sf_dir)
    return claims.extract(df, claims.default_repo(F.col("namespace"), F.lit(None).cast("string"))).select("memory_id", "namespace", "kind", "ref", "state")


_CLAIMS = ", c AS (SELECT id AS memory_id, namespace, confidence, namespace || '#' || (id % 50) AS ref, CASE id % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'open' ELSE 'unverified' END AS state FROM memories) "


@query(_CLAIMS + "SELECT a.memory_id, a.namespace, 'pr' AS kind, a.ref FROM c a WHERE a.state = 'open' AND a.confidence <> 'deprecated' AND EXISTS (SELECT 1 FROM c b WHERE b.namespace = a.namespace AND b.ref = a.ref AND b.state = 'resolved' AND b.confidence <> 'deprecated' AND b.memory_id <> a.memory_id)")
def contradicted(spark, sf_dir):
    df = views.claim_texts(spark, sf_dir)
    found = claims.extract(df, F.col("namespace"))
    return claims.contradicted(found, df.where("confidence <> 'deprecated'").select("id")).select("memory_id", "namespace", "kind", "ref")


@query(_CLAIMS + "SELECT count(*) FILTER (state = 'open') AS open, count(*) FILTER (state = 'open' AND confidence <> 'deprecated') AS open_actionable, count(*) FILTER (state = 'resolved') AS resolved, count(*) FILTER (state = 'unverified') AS unverified, (SELECT count(*) FROM c a WHERE a.state = 'open' AND a.confidence <> 'deprecated' AND EXISTS (SELECT 1 FROM c b WHERE b.namespace = a.namespace AND b.ref = a.ref AND b.state = 'resolved' AND b.confidence <> 'deprecated' AND b.memory_id <> a.memory_id)) AS contradicted FROM c")
def claim_stats(spark, sf_dir):
    df = views.claim_texts(spark, sf_dir)
    return claims.statistics(claims.extract(df, F.col("namespace")), df)


_AGAINST = "EXISTS (SELECT 1 FROM c b WHERE b.namespace = a.namespace AND b.ref = a.ref AND b.state = 'resolved' AND b.confidence <> 'deprecated' AND b.memory_id <> a.memory_id)"


@query(_CLAIMS + f"SELECT id, a.ref, {_AGAINST} AS contradicted FROM c a JOIN memories ON id = a.memory_id WHERE state = 'open' AND a.confidence <> 'deprecated' ORDER BY {_AGAINST} DESC, created_at, id LIMIT 40")
def claims_sample(spark, sf_dir):
    """The first forty of the backlog of open claims."""
    df = views.claim_texts(spark, sf_dir)
    return claims.sample(claims.extract(df, F.col("namespace")), df, 40).select("id", "ref", "contradicted")


@query(_CLAIMS + f"""SELECT id, 'open' AS mode FROM c a JOIN memories m ON m.id = a.memory_id ANTI JOIN degree d ON d.id = m.id WHERE state = 'open' AND a.confidence <> 'deprecated' AND list_contains(tags, 'en')
 UNION ALL SELECT id, 'contradicted' FROM c a JOIN memories m ON m.id = a.memory_id WHERE state = 'open' AND a.confidence = 'inferred' AND type = 'decision' AND {_AGAINST}""")
def filter_claims_orphans(spark, sf_dir):
    """The composed filter with claims and orphans: open claims of orphans with a tag, contradicted claims of one type and confidence."""
    df = views.claim_texts(spark, sf_dir)
    found = saved(claims.extract(df, F.col("namespace")), "claims")
    one = filters.select_memories(df, tags=["en"], claims=(found, "open"), orphans_of=relations(spark, sf_dir)).select("id", F.lit("open").alias("mode"))
    other = filters.select_memories(df, type="decision", claims=(found, "contradicted")).where("confidence = 'inferred'")
    return one.union(other.select("id", F.lit("contradicted")))


@query("""SELECT id AS memory_id, CASE WHEN id % 6 = 5 THEN 'mr' ELSE 'pr' END AS kind, CASE id % 6 WHEN 0 THEN 'tool' WHEN 1 THEN 'other-repo' ELSE namespace END || '#' || (id % 50) AS ref,
 CASE WHEN id % 6 = 0 THEN 'resolved' ELSE 'open' END AS state FROM memories WHERE id % 6 IN (0, 1, 5)""")
def claims_forms(spark, sf_dir):
    """Claims by a url, by an alias and of merge requests; none in wiki links, quotes and code."""
    number = (F.col("id") % 50).cast("string")
    put = lambda *parts: F.concat("content", F.lit("\n"), *[number if p is None else F.lit(p) for p in parts])
    forms = [put("see https://github.com/acme/tool/pull/", None, " and PR #", None, " merged"), put("other PR #", None, " open"), put("[[PR #", None, " merged]]"), put('it said "PR #', None, ' merged" then'), put("`PR #", None, " merged`"), put("MR !", None, " is held")]
    text = F.element_at(F.array(*forms), (F.col("id") % 6 + 1).cast("int"))
    found = claims.extract(memories(spark, sf_dir).withColumn("content", text), F.col("namespace"), {"other": "other-repo"})
    return found.select("memory_id", "kind", "ref", "state")


_DATED = "CASE id % 4 WHEN 0 THEN ' expires 2024-01-10' WHEN 1 THEN ' as of 2024-01-05' WHEN 2 THEN ' expires 2025-01-01' ELSE ' waiting on Joe' END"


@query("""SELECT id, array_to_string(list_filter([
 CASE WHEN id % 4 = 0 AND NOT coalesce(last_confirmed >= TIMESTAMP '2024-01-11', false) THEN 'expired-date' END,
 CASE WHEN id % 4 = 1 AND NOT coalesce(last_confirmed >= TIMESTAMP '2024-01-06', false) THEN 'stale-as-of-date' END,
 CASE WHEN id % 4 = 3 AND type NOT IN ('pattern','preference') AND age_days >= 14 THEN 'waiting-on' END], lambda x: x IS NOT NULL), ',') AS signals FROM scored WHERE confidence <> 'deprecated' AND signals <> ''""")
def review_signals(spark, sf_dir):
    """Texts get a date or a state from their id, so the expected signals follow from the row."""
    df = memories(spark, sf_dir).withColumn("content", F.concat("content", F.lit("\n"), F.expr(_DATED)))
    return review.sweep(df, now()).select("id", F.array_join("signals", ",").alias("signals"))


# promotion, evaluation, transitions


@query(r"""SELECT id, regexp_matches(content, '(?:sk-[A-Za-z0-9]{8,})|(?:AKIA[0-9A-Z]{16})|(?:(?i:secret_access_key))|(?:Bearer\s+[A-Za-z0-9._-]{20,})|(?:-----BEGIN)|(?:[a-fA-F0-9]{32,})|(?:password["'']?\s*[:=]\s*\S)') AS secret FROM memories""")
def secret_scan(spark, sf_dir):
    return memories(spark, sf_dir).select("id", promote.contains_secret(F.col("content")).alias("secret"))


_SECRET = r"""regexp_matches(content, '(?:sk-[A-Za-z0-9]{8,})|(?:AKIA[0-9A-Z]{16})|(?:(?i:secret_access_key))|(?:Bearer\s+[A-Za-z0-9._-]{20,})|(?:-----BEGIN)|(?:[a-fA-F0-9]{32,})|(?:password["'']?\s*[:=]\s*\S)')"""


@query(f"SELECT id FROM memories WHERE confidence = 'verified' AND NOT list_contains(tags, 'fr') AND NOT {_SECRET}")
def promotable(spark, sf_dir):
    return memories(spark, sf_dir).where(promote.promotable([*promote.EXCLUDED_TAGS, "fr"])).select("id")


@query(f"SELECT count(*) AS candidates, count(*) FILTER (ok) AS promotable, count(*) FILTER (NOT ok) AS filtered_out, count(*) FILTER (ok AND id % 7 = 0) AS already_promoted, count(*) FILTER (ok AND id % 7 <> 0) AS promoted FROM (SELECT id, confidence = 'verified' AND NOT {_SECRET} AS ok FROM memories) x")
def promotion_report(spark, sf_dir):
    df = memories(spark, sf_dir)
    there = df.where("id % 7 = 0").select(promote.provenance("here", "me", "2024-02-15").alias("metadata"))
    return promote.report(df, there)


_QUALITY = r"""
, toks AS (
  SELECT id, list_filter(regexp_split_to_array(lower(title || ' ' || content), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM memories
), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM toks)
, questions AS (
  SELECT item_id AS question, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS q FROM benchmark
), asked AS (SELECT question, unnest(q) AS term FROM questions)
, post AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM toks) x WHERE term IN (SELECT term FROM asked) GROUP BY ALL)
, df AS (SELECT term, count(*) AS df FROM post GROUP BY term)
, sc AS (SELECT question, id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS bm25 FROM post JOIN df USING (term) JOIN asked USING (term), st GROUP BY ALL)
, ranking AS (SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY bm25 DESC, id) AS rank FROM sc QUALIFY rank <= 10)
, relevant AS (SELECT b.item_id AS question, d.doc_id AS id FROM benchmark b JOIN questions q ON q.question = b.item_id AND len(q.q) >= 5 JOIN documents d ON contains(d.text, b.text))
"""


def _questions(spark, sf_dir):
    """The benchmark passages as questions, and the documents that hold one whole; passages of fewer than five words have none.

    Documents and passages meet on runs of three words: the second to fourth word of a passage stand whole in
    every text that holds it.  A text is looked through where it is read, and goes on only with the runs that it shares.
    """
    given = views.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), F.col("text").alias("query"), tx.words(F.col("text")).alias("w"))
    run = lambda w, i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))
    starts = given.where("size(w) >= 5").select("question", "query", run(F.col("w"), F.lit(2)).alias("run"))
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    words = docs.select("id", "text", tx.words(F.col("text")).alias("w")).where("size(w) >= 3")
    every = starts.agg(F.collect_set("run").alias("runs"))  # a number for each question
    runs = words.crossJoin(F.broadcast(every)).select("id", "text", F.explode(F.array_intersect(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: run(F.col("w"), i)), "runs")).alias("run"))
    met = runs.join(F.broadcast(starts) if starts.count() <= S.BROADCAST_ROWS else starts, "run")
    return given.select("question", "query"), met.where(F.col("text").contains(F.col("query"))).select("question", "id").distinct()


@query(_QUALITY + """SELECT count(*) AS questions, round(avg(h1 / wanted), 6) AS recall_1, round(avg(h5 / wanted), 6) AS recall_5, round(avg(h10 / wanted), 6) AS recall_10,
 round(avg(h1 / 1), 6) AS precision_1, round(avg(h5 / 5), 6) AS precision_5, round(avg(h10 / 10), 6) AS precision_10, round(avg(rr), 6) AS reciprocal_rank
 FROM (SELECT r.question, count(*) AS wanted, count(k.rank) FILTER (k.rank <= 1) AS h1, count(k.rank) FILTER (k.rank <= 5) AS h5, count(k.rank) FILTER (k.rank <= 10) AS h10, coalesce(1.0 / min(k.rank), 0) AS rr
 FROM relevant r LEFT JOIN ranking k ON k.question = r.question AND k.id = r.id GROUP BY r.question) x""")
def retrieval_quality(spark, sf_dir):
    questions, relevant = _questions(spark, sf_dir)
    ranking = search.batch_bm25(memories(spark, sf_dir), questions, 10)
    means = evaluate.summary(evaluate.scored(ranking, relevant))
    return means.select("questions", *[F.round(c, 6).alias(c) for c in means.columns if c != "questions"])


_BENCHMARK = _QUALITY + """
, asks AS (
  SELECT question, 'abc'[question % 3 + 1] AS kind, CASE WHEN question % 2 = 1 THEN ['src0', 'src1', 'src2', 'src3', 'src5', 'src8'] ELSE [] END AS spaces, vector FROM questions LEFT JOIN vectors ON id = question
), kept AS (
  SELECT question, vector, m.* FROM asks, scored m WHERE confidence <> 'deprecated' AND (len(spaces) = 0 OR list_contains(spaces, namespace))
), pool AS (
  SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY bm25 DESC, id) AS br FROM sc JOIN kept USING (question, id) QUALIFY br <= 40
), sim AS (
  SELECT question, id, list_cosine_similarity(v.vector, k.vector) AS s FROM kept k JOIN vectors v USING (id) WHERE k.vector IS NOT NULL
), sem AS (
  SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY s DESC, id) AS sr FROM (
    SELECT * FROM sim SEMI JOIN pool USING (question, id)
    UNION ALL (SELECT * FROM sim ANTI JOIN pool USING (question, id) WHERE s >= 0.2 QUALIFY row_number() OVER (PARTITION BY question ORDER BY s DESC, id) <= 5)
  ) x
), rrf AS (
  SELECT question, id, least(1.0, (coalesce(1.0 / (60 + br), 0) + coalesce(1.0 / (60 + sr), 0)) / (CASE WHEN max(sr) OVER (PARTITION BY question) IS NOT NULL THEN 2.0 ELSE 1.0 END / 61)) AS relevance
  FROM pool FULL JOIN sem USING (question, id)
), ranks AS (
  SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY 0.45*relevance + 0.10*fresh + 0.10*access + 0.35*trust DESC, id) AS rank FROM rrf JOIN scored USING (id) QUALIFY rank <= 10
), per AS (
  SELECT r.question, count(*) AS wanted, count(k.rank) FILTER (k.rank <= 1) AS h1, count(k.rank) FILTER (k.rank <= 5) AS h5, count(k.rank) FILTER (k.rank <= 10) AS h10, coalesce(1.0 / min(k.rank), 0) AS rr
  FROM relevant r LEFT JOIN ranks k ON k.question = r.question AND k.id = r.id GROUP BY r.question
)
SELECT coalesce(kind, 'overall') AS kind, count(*) AS questions, round(avg(h1 / wanted), 6) AS recall_1, round(avg(h5 / wanted), 6) AS recall_5, round(avg(h10 / wanted), 6) AS recall_10,
 round(avg(h1 / 1), 6) AS precision_1, round(avg(h5 / 5), 6) AS precision_5, round(avg(h10 / 10), 6) AS precision_10, round(avg(rr), 6) AS reciprocal_rank
FROM per JOIN asks USING (question) GROUP BY GROUPING SETS ((kind), ())
"""


@query(_BENCHMARK)
def benchmark_hybrid(spark, sf_dir):
    """All benchmark passages through hybrid search, odd ones within six namespaces, by kind and overall."""
    questions, relevant = _questions(spark, sf_dir)
    df = memories(spark, sf_dir)
    vectors = views.embeddings(spark, sf_dir)
    spaces = F.when(F.col("question") % 2 == 1, F.array(*[F.lit(f"src{i}") for i in (0, 1, 2, 3, 5, 8)])).otherwise(F.array().cast("array<string>"))
    asked = questions.join(vectors.withColumnRenamed("id", "question"), "question", "left").withColumn("namespaces", spaces).withColumn("kind", F.substring(F.lit("abc"), (F.col("question") % 3 + 1).cast("int"), F.lit(1)))
    found = benchmark.ranking(views.texts(spark, sf_dir), filters.select_memories(df), asked, vectors, now(), 10, S.WEIGHTS, FLOOR)
    means = benchmark.by_kind(found, relevant, asked)
    return means.select("kind", "questions", *[F.round(c, 6).alias(c) for c in means.columns if c not in ("kind", "questions")])


@query("SELECT id, access_count + 1 AS access_count FROM memories WHERE id % 11 = 3 UNION ALL SELECT id, access_count FROM memories WHERE id % 11 <> 3")
def record_access(spark, sf_dir):
    df = memories(spark, sf_dir)
    log = df.where("id % 11 = 3").select(F.col("id").alias("memory_id"), now().alias("accessed_at"))
    return state.accessed(df, log).select("id", "access_count")


@query("SELECT id, CASE WHEN id % 9 = 2 THEN 'verified' ELSE confidence END AS confidence, CASE WHEN id % 9 = 2 THEN true ELSE last_confirmed IS NOT NULL END AS confirmed FROM memories")
def update_memories(spark, sf_dir):
    df = memories(spark, sf_dir)
    patch = df.where("id % 9 = 2").select("id", F.lit("verified").alias("confidence"))
    return state.updated(df, patch, now()).select("id", "confidence", F.col("last_confirmed").isNotNull().alias("confirmed"))


@query("SELECT id FROM memories ANTI JOIN vectors USING (id) ORDER BY id LIMIT 50")
def unembedded(spark, sf_dir):
    return state.unembedded(memories(spark, sf_dir), views.embeddings(spark, sf_dir), 64, 50).select("id")


@query("SELECT (SELECT count(*) FROM memories WHERE namespace IN ('src0', 'src1')) AS memories, (SELECT count(*) FROM relations SEMI JOIN (SELECT id FROM memories WHERE namespace IN ('src0', 'src1')) x ON x.id = source_id SEMI JOIN (SELECT id FROM memories WHERE namespace IN ('src0', 'src1')) y ON y.id = target_id) AS relations")
def export_import_roundtrip(spark, sf_dir):
    """Two namespaces written as JSON lines, read back and imported into one of them."""
    df, edges = memories(spark, sf_dir), relations(spark, sf_dir)
    both = df.where("namespace IN ('src0', 'src1')")
    own, inner = portability.export_rows(both, edges)
    path = new_path(spark, "export")
    portability.export_lines(own, inner, path)
    m, r = portability.read_lines(spark, path, own.schema, inner.schema)
    there, old = portability.export_rows(df, edges, "src0")
    every, linked = portability.imported(there, old, m, r)
    return every.agg(F.count("*").alias("memories")).join(F.broadcast(linked.agg(F.count("*").alias("relations"))))


@query("SELECT epoch_us(date_trunc('hour', accessed_at)) // 1000000 AS start, context, count(*) AS n FROM access_log GROUP BY ALL")
def access_windows(spark, sf_dir):
    """The streaming operator's windows, run as a batch."""
    from lorekeep.streaming.access import windowed_accesses

    df = windowed_accesses(views.access_log(spark, sf_dir))
    return df.select(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("start").cast("timestamp_ntz")).alias("start"), "context", "n")


@query("SELECT memory_id, count(*) AS n, epoch_us(max(accessed_at)) AS last FROM (SELECT *, date_trunc('day', accessed_at) + INTERVAL 31 DAY > TIMESTAMP '2024-02-15' AS kept FROM access_log) x GROUP BY memory_id HAVING count(*) FILTER (kept) > 0".replace("count(*) AS n", "count(*) FILTER (kept) AS n"))
def access_retained(spark, sf_dir):
    """The counts that the stateful stream keeps, run as a batch."""
    from lorekeep.streaming.access import retained

    df = retained(views.access_log(spark, sf_dir), 1_707_955_200_000, 30)
    return df.select("memory_id", "n", F.unix_micros("last").alias("last"))


@query("SELECT edge_id, (SELECT count(*) FROM relations WHERE relation_type = 'caused_by') AS total FROM relations WHERE relation_type = 'caused_by' ORDER BY source_id, edge_id LIMIT 25 OFFSET 10")
def edges_page_total(spark, sf_dir):
    """A page beside the total."""
    total, rows = listing.page(relations(spark, sf_dir).where("relation_type = 'caused_by'"), [F.col("source_id"), F.col("edge_id")], 10, 25)
    return rows.select("edge_id", F.lit(total).cast("long").alias("total"))


# index, dispatch, hints, namespaces, repairs


@query(_WORDS + "SELECT id, round(bm25, 6) AS bm25 FROM bm ORDER BY round(bm25, 9) DESC, id LIMIT 25")
def bm25_indexed(spark, sf_dir):
    path = new_path(spark, "postings")
    postings.write(views.texts(spark, sf_dir), path)
    df = postings.bm25(spark, path, QUERY)
    return df.orderBy(F.round("bm25", 9).desc(), "id").limit(25).select("id", F.round("bm25", 6).alias("bm25"))


@query(_FUSED + "SELECT id, round(0.45*relevance + 0.10*fresh + 0.10*access + 0.35*trust, 6) AS score FROM fused JOIN scored USING (id) ORDER BY 0.45*relevance + 0.10*fresh + 0.10*access + 0.35*trust DESC, id LIMIT 10")
def hybrid_indexed(spark, sf_dir):
    """Hybrid search whose keyword pool comes from the index; no text is read for it."""
    df = memories(spark, sf_dir)
    index = postings.write(views.texts(spark, sf_dir), new_path(spark, "postings"))
    bare = df.drop("content")
    found = search.hybrid(bare, filters.select_memories(bare), views.embeddings(spark, sf_dir), QUERY, vector(spark, sf_dir), now(), 10, S.WEIGHTS, FLOOR, index=index)
    return found.select("id", F.round("score", 6).alias("score"))


_CHANGED = """
, changed AS (
  SELECT id, title, CASE WHEN id % 10 = 3 THEN content || ' the thand reanon' ELSE content END AS content FROM memories WHERE id % 10 <> 4
)""" + _WORDS.replace("FROM memories", "FROM changed")


@query(_CHANGED + """, best AS (SELECT id, round(bm25, 6) AS bm25, round(bm25, 9) AS b FROM bm)
 SELECT 'delta' AS state, id, bm25 FROM (SELECT * FROM best ORDER BY b DESC, id LIMIT 50) x
 UNION ALL SELECT 'compacted', id, bm25 FROM (SELECT * FROM best ORDER BY b DESC, id LIMIT 50) x
 UNION ALL SELECT 'all', id, bm25 FROM best""")
def index_upkeep(spark, sf_dir):
    """The index after updates and deletions in two further segments, and after compaction, gives the scores of the changed corpus."""
    df = views.texts(spark, sf_dir).select("id", "title", "content")
    path = new_path(spark, "postings")
    postings.write(df, path)
    old, gone = df.where("id % 10 = 3"), df.where("id % 10 = 4")
    postings.changed(spark, path, old, old.withColumn("content", F.concat("content", F.lit(" the thand reanon"))))
    index = postings.changed(spark, path, gone, df.limit(0))
    top = lambda name, index: saved(index.top(QUERY, 50).select(F.lit(name).alias("state"), "id", F.round("bm25", 6).alias("bm25")), "top")
    delta, every = top("delta", index), saved(index.bm25(QUERY).select(F.lit("all").alias("state"), "id", F.round("bm25", 6).alias("bm25")), "all")
    return delta.union(top("compacted", postings.compacted(spark, path))).union(every)


_DISPATCHED = (
    _FUSED
    + """, h AS (SELECT id, row_number() OVER (ORDER BY 0.45*relevance + 0.10*fresh + 0.10*access + 0.35*trust DESC, id) AS place FROM fused JOIN scored USING (id) QUALIFY place <= 10),
 m AS (SELECT id, row_number() OVER (ORDER BY last_accessed DESC, id) AS place FROM bm JOIN memories USING (id) WHERE confidence <> 'deprecated' QUALIFY place <= 10),
 l AS (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS place FROM memories WHERE confidence <> 'deprecated' QUALIFY place <= 10),
 s AS (SELECT id, row_number() OVER (ORDER BY 0.45*0.5 + 0.10*fresh + 0.10*access + 0.35*trust DESC, id) AS place FROM scored WHERE confidence <> 'deprecated' QUALIFY place <= 10)
 SELECT 'query relevance' AS asked, id FROM h UNION ALL SELECT 'query accessed', id FROM m UNION ALL SELECT 'created', id FROM l UNION ALL SELECT 'decay_score', id FROM s"""
)


@query(_DISPATCHED)
def search_dispatch(spark, sf_dir):
    """One search for each strategy: a query by relevance and by time, none by time and by score."""
    return _each_strategy(spark, sf_dir, memories(spark, sf_dir))


@query(_DISPATCHED)
def search_dispatch_indexed(spark, sf_dir):
    """The same strategies with the keyword index instead of the texts."""
    df = memories(spark, sf_dir)
    index = postings.write(views.texts(spark, sf_dir), new_path(spark, "postings"))
    return _each_strategy(spark, sf_dir, df.drop("content"), index)


def _each_strategy(spark, sf_dir, df, index=None):
    kept = filters.select_memories(df)
    cases = {"query relevance": (QUERY, "relevance"), "query accessed": (QUERY, "accessed"), "created": (None, "created"), "decay_score": (" ", "decay_score")}
    found = None
    for name, (text, order) in cases.items():
        one = search.dispatched(df, kept, now(), text, order, 10, views.embeddings(spark, sf_dir), vector(spark, sf_dir), S.WEIGHTS, FLOOR, index).select(F.lit(name).alias("asked"), "id")
        found = one if found is None else found.union(one)
    return found


@query(_CLAIMS + """SELECT 'open' AS mode, memory_id AS id FROM c WHERE state = 'open' UNION ALL SELECT 'unverified', memory_id FROM c WHERE state = 'unverified'
 UNION ALL SELECT 'contradicted', a.memory_id FROM c a WHERE a.state = 'open' AND a.confidence <> 'deprecated' AND EXISTS (SELECT 1 FROM c b WHERE b.namespace = a.namespace AND b.ref = a.ref AND b.state = 'resolved' AND b.confidence <> 'deprecated' AND b.memory_id <> a.memory_id)""")
def claims_mode(spark, sf_dir):
    df = views.claim_texts(spark, sf_dir)
    found = saved(claims.extract(df, F.col("namespace")), "claims")
    own = saved(df.select("id", "confidence"), "memories")
    modes = [claims.in_mode(own, found, mode).select(F.lit(mode).alias("mode"), "id") for mode in ("open", "unverified", "contradicted")]
    return modes[0].union(modes[1]).union(modes[2])


_SIMILAR = f"""
, q AS (SELECT list_distinct(['the','thand','ertion','reanon']) AS t), hint AS (
  SELECT id, round(bm25, 9) AS b FROM bm JOIN memories USING (id) WHERE namespace = 'src3' AND confidence <> 'deprecated'
), gate AS (
  SELECT m.id, len(list_intersect({_TOKENS.format("m.title || ' ' || m.content")}, q.t)) / len(list_distinct(list_concat({_TOKENS.format("m.title || ' ' || m.content")}, q.t))) AS s FROM memories m, q
)
"""


@query(_WORDS + _SIMILAR + "SELECT id, round(s, 4) AS similarity FROM (SELECT id FROM hint ORDER BY b DESC, id LIMIT 6) x JOIN gate USING (id) WHERE s >= 0.15 ORDER BY round(s, 4) DESC, id LIMIT 3")
def find_similar(spark, sf_dir):
    return hints.find_similar(memories(spark, sf_dir), "src3", QUERY, now()).select("id", "similarity")


_NEAR_HINT = _FUSED.replace("confidence <> 'deprecated'", "confidence <> 'deprecated' AND namespace = 'src0'").replace("s >= 0.2", "s >= 0.55")


@query(_NEAR_HINT + """, hint AS (SELECT id FROM fused ORDER BY relevance DESC, id LIMIT 6)
 SELECT id, round(s, 4) AS similarity FROM hint JOIN sim USING (id) WHERE s >= 0.05 ORDER BY round(s, 4) DESC, id LIMIT 3""")
def find_similar_vectors(spark, sf_dir):
    """Hints by vectors; these are random, so the gate is lowered to where some pass."""
    df = memories(spark, sf_dir)
    pool = hints.candidates(df, "src0", QUERY, now(), 6, views.embeddings(spark, sf_dir), vector(spark, sf_dir))
    return cluster.similar_to(pool, views.embeddings(spark, sf_dir), QUERY, vector(spark, sf_dir), (0.05, 0.0), 3).select("id", "similarity")


@query(_WORDS + _SIMILAR + """, skip AS (SELECT 10 AS id UNION SELECT other FROM ends WHERE id = 10)
 SELECT id, round(s, 4) AS similarity FROM (SELECT id, row_number() OVER (ORDER BY b DESC, id) AS place FROM hint) x JOIN gate USING (id) ANTI JOIN skip USING (id)
 WHERE place <= 6 + (SELECT count(*) FROM skip) AND s >= 0.10 ORDER BY round(s, 4) DESC, id LIMIT 3""")
def suggest_relations(spark, sf_dir):
    return hints.suggest_relations(memories(spark, sf_dir), relations(spark, sf_dir), "src3", QUERY, now(), 10).select("id", "similarity")


@query("SELECT id AS memory_id, CASE namespace WHEN 'src1' THEN 'other' ELSE namespace END || '#' || (id % 50) AS ref, namespace = 'src1' AS rederived FROM memories")
def namespace_update(spark, sf_dir):
    """A new default repo for one namespace: its claims are derived again."""
    given = _namespaces(spark, sf_dir).withColumn("default_repo", F.lit(None).cast("string"))
    patch = spark.range(1).select(F.lit("src1").alias("name"), F.lit("other").alias("default_repo"))
    new, moved = namespaces.updated(given, patch)
    df = views.claim_texts(spark, sf_dir).join(new.select(F.col("name").alias("namespace"), "default_repo"), "namespace")
    found = claims.extract(df, claims.default_repo(F.col("namespace"), F.col("default_repo")))
    changed = moved.select(F.col("name").alias("namespace"), F.lit(True).alias("moved"))
    return found.join(changed, "namespace", "left").select("memory_id", "ref", F.coalesce("moved", F.lit(False)).alias("rederived"))


@query(_NAMES + """, held AS (SELECT name, count(m.id) AS n FROM names LEFT JOIN memories m ON m.namespace = name GROUP BY name)
 SELECT a.name, CAST(coalesce(n, 0) AS BIGINT) AS n, CASE WHEN held.name IS NULL THEN 'not_found' WHEN n > 0 THEN 'not_empty' ELSE 'deleted' END AS outcome FROM (VALUES ('src1'), ('src2-old'), ('nowhere')) a(name) LEFT JOIN held ON held.name = a.name""")
def namespace_delete(spark, sf_dir):
    names = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in ("src1", "src2-old", "nowhere")])).alias("name"))
    return namespaces.outcome_of(_namespaces(spark, sf_dir), memories(spark, sf_dir), names)


@query("SELECT namespace, count(*) AS n FROM memories WHERE namespace <> 'src1' GROUP BY namespace")
def namespace_cascade(spark, sf_dir):
    names = spark.range(1).select(F.lit("src1").alias("name"))
    left = namespaces.deleted(_namespaces(spark, sf_dir), memories(spark, sf_dir), names, cascade=True)[1]
    return stats.by(left, "namespace")


@query("""SELECT edge_id, source_id, target_id, relation_type FROM relations r WHERE NOT EXISTS (SELECT 1 FROM relations g WHERE g.source_id % 11 = 0 AND g.source_id = r.source_id AND g.target_id = r.target_id)
 AND NOT (source_id % 7 = 0 AND relation_type = 'related_to')""")
def edges_deleted(spark, sf_dir):
    """Edges deleted one by one by their type, and all types between two memories."""
    edges = relations(spark, sf_dir)
    one = edges.where("source_id % 7 = 0 AND relation_type = 'related_to'").select("source_id", "target_id", "relation_type")
    every = edges.where("source_id % 11 = 0").select("source_id", "target_id", F.lit(None).cast("string").alias("relation_type"))
    return graph.without_edges(edges, one.union(every)).select("edge_id", "source_id", "target_id", "relation_type")


# Three rounds of repairs: retype, then reverse what was retyped, then delete all types of a direction.
_REPAIRED = """
, e0 AS (
  SELECT min(edge_id) AS edge_id, source_id AS s, target_id AS t, relation_type AS k FROM relations GROUP BY ALL
), r1 AS (
  SELECT *, CASE WHEN EXISTS (SELECT 1 FROM e0 x WHERE x.s = e0.s AND x.t = e0.t AND x.k = 'related_to') THEN 'merged' ELSE 'retyped' END AS outcome
  FROM e0 WHERE s % 10 IN (1, 3) AND k = 'caused_by'
), e1 AS (
  SELECT edge_id, s, t, k FROM e0 ANTI JOIN r1 USING (edge_id) UNION ALL SELECT edge_id, s, t, 'related_to' FROM r1 WHERE outcome = 'retyped'
), o2 AS (
  SELECT edge_id AS place, s, t FROM e0 WHERE s % 10 IN (1, 3, 5) AND k IN ('caused_by', 'related_to')
), o2a AS (
  SELECT min(place) AS place, s, t FROM o2 GROUP BY s, t
), r2 AS (
  SELECT o.place, e.edge_id, o.s, o.t, CASE WHEN e.edge_id IS NULL THEN 'not_found'
   WHEN x.edge_id IS NOT NULL AND (y.place IS NULL OR y.place > o.place) THEN 'merged' ELSE 'reversed' END AS outcome
  FROM o2a o LEFT JOIN e1 e ON e.s = o.s AND e.t = o.t AND e.k = 'related_to' LEFT JOIN e1 x ON x.s = o.t AND x.t = o.s AND x.k = 'related_to' LEFT JOIN o2a y ON y.s = o.t AND y.t = o.s
), e2 AS (
  SELECT edge_id, s, t, k FROM e1 ANTI JOIN r2 ON r2.edge_id = e1.edge_id UNION ALL SELECT edge_id, t, s, 'related_to' FROM r2 WHERE outcome = 'reversed'
), o3 AS (
  SELECT DISTINCT s, t FROM e0 WHERE s % 10 IN (7, 0)
), r3 AS (
  SELECT o.s, o.t, count(e.edge_id) AS n FROM o3 o LEFT JOIN e2 e ON e.s = o.s AND e.t = o.t GROUP BY ALL
), e3 AS (
  SELECT * FROM e2 ANTI JOIN o3 ON o3.s = e2.s AND o3.t = e2.t
)
"""


def _repairs(spark, sf_dir):
    """The distinct edges, and three rounds of ops on them: the second on edges that the first made."""
    edges = saved(relations(spark, sf_dir).groupBy("source_id", "target_id", "relation_type").agg(F.min("edge_id").alias("edge_id")), "edges")
    op = lambda df, round_, name, old, new: df.select((F.col("place") + round_ * 1_000_000_000_000).alias("place"), F.lit(name).alias("op"), "source_id", "target_id", F.lit(old).cast("string").alias("relation_type"), F.lit(new).cast("string").alias("new_type"))
    by = lambda df: df.groupBy("source_id", "target_id").agg(F.min("edge_id").alias("place"))
    one = op(edges.where("source_id % 10 IN (1, 3) AND relation_type = 'caused_by'").withColumn("place", F.col("edge_id")), 1, "retype", "caused_by", "related_to")
    two = op(by(edges.where("source_id % 10 IN (1, 3, 5) AND relation_type IN ('caused_by', 'related_to')")), 2, "reverse", "related_to", None)
    return edges, one.union(two).union(op(by(edges.where("source_id % 10 IN (7, 0)")), 3, "delete", None, None))


@query(_REPAIRED + "SELECT edge_id, s AS source_id, t AS target_id, k AS relation_type FROM e3")
def edges_repaired(spark, sf_dir):
    """The edges that are left after the repairs in order, an edge turned into another type and round in one batch."""
    edges, ops = _repairs(spark, sf_dir)
    return repair.repaired(edges, repair.validated(ops, most=None))[0].select("edge_id", "source_id", "target_id", "relation_type")


@query(_REPAIRED + """SELECT 'retype' AS op, s AS source_id, t AS target_id, outcome, CAST(NULL AS BIGINT) AS removed FROM r1 UNION ALL SELECT 'reverse', s, t, outcome, NULL FROM r2
 UNION ALL SELECT 'delete', s, t, CASE WHEN n > 0 THEN 'deleted' ELSE 'not_found' END, n FROM r3""")
def edge_batch_repair(spark, sf_dir):
    """The outcome of every op of the batch."""
    edges, ops = _repairs(spark, sf_dir)
    told = repair.repaired(edges, ops)[1]
    return told.select("op", "source_id", "target_id", "outcome", F.when(F.col("removed_types").isNotNull(), F.size("removed_types")).cast("long").alias("removed"))


@query("SELECT namespace, title, count(*) AS n FROM memories GROUP BY namespace, title HAVING count(*) > 1")
def consolidate_fallback(spark, sf_dir):
    """The wanted model has vectors of 384 numbers and no memory has one, so the clusters are those of equal titles."""
    wanted = views.embeddings(spark, sf_dir).where("size(vector) = 384")
    return cluster.clusters_or_titles(memories(spark, sf_dir), wanted, new_path(spark, "clusters"))[1].select("namespace", "title", "n")


@query("SELECT id, namespace, round(0.45*0.5 + 0.10*fresh + 0.10*access + 0.35*trust, 4) AS score, array_to_string(list_sort(tags), ',') AS tags FROM scored")
def full_summaries(spark, sf_dir):
    df = memories(spark, sf_dir).select(tx.summary(sc.composite(F.lit(0.5), now())).alias("s")).select("s.*")
    return df.select("id", "namespace", "score", F.array_join("tags", ",").alias("tags"))


@query("SELECT id, 4 * len(vector) AS bytes, round(vector[1], 6) AS first FROM vectors")
def packed_vectors(spark, sf_dir):
    df = views.embeddings(spark, sf_dir).withColumn("packed", tx.packed_vector("vector"))
    return df.select("id", F.octet_length("packed").cast("long").alias("bytes"), F.round(tx.unpacked_vector("packed")[0].cast("double"), 6).alias("first"))


@query("SELECT id, namespace, row_number() OVER (PARTITION BY namespace ORDER BY last_accessed, id) AS place FROM memories")
def decay_groups(spark, sf_dir):
    return stats.grouped_by_decay(memories(spark, sf_dir), now(), "days").select("id", "namespace", F.col("place").cast("long").alias("place"))


@query("SELECT DISTINCT t AS tag FROM (SELECT unnest(tags) AS t FROM memories) x")
def tag_table(spark, sf_dir):
    """The tags in use; a known one that no memory has goes."""
    known = spark.range(1).select(F.explode(F.array(F.lit("en"), F.lit("nobody-has-this"))).alias("tag"))
    return namespaces.tag_table(known, namespaces.tags_of(memories(spark, sf_dir)))


# the change log


def _log(spark, sf_dir):
    """Events as operations on memories: by event_id, dealt over all of them."""
    n = views.table(spark, sf_dir, "documents").count()
    e, own = F.col("event_id"), F.floor(F.col("event_id") / 3) % 8
    text = lambda c: F.lit(None).cast("string") if c is None else c
    op = (
        F.when(own == 0, "access").when((own == 3) & (e % 5 != 0), "touch").when(own == 3, "forget").when(own == 5, "tag")
        .when((own == 6) & (e % 5 == 1), "delete").when(own == 6, "relate").when(own == 7, "store").otherwise("update")
    )
    return views.table(spark, sf_dir, "events").select(
        e.alias("place"), F.col("ts").alias("at"), op.alias("op"), (e * e % n).alias("id"),
        F.when(own == 7, "src0").alias("namespace"), F.when(own == 7, "fact").alias("type"), F.when(own == 7, "again").alias("title"),
        F.when(own == 2, F.concat(F.lit("new text "), e.cast("string"))).when(own == 7, F.concat(F.lit("stored "), e.cast("string"))).alias("content"),
        F.when(own == 1, F.when(e % 3 == 0, "verified").otherwise("stale")).when(own == 7, F.when(e % 2 == 0, "verified").otherwise("inferred")).alias("confidence"),
        text(None).alias("source"), F.when(own == 4, F.when(e % 2 == 0, F.concat(F.lit('{"b": 1, "a": '), e.cast("string"), F.lit("}"))).otherwise("")).alias("metadata"),
        F.lit(None).cast("boolean").alias("pinned"), F.when(own == 5, F.array(F.concat(F.lit(" T "), (e % 3).cast("string")))).alias("tags"),
        ((e * e + 1) % n).alias("target_id"), F.when(own == 6, "caused_by").alias("relation_type"),
    )


_REPLAYED = """
, ev AS (
  SELECT event_id AS place, ts, event_id * event_id % (SELECT count(*) FROM documents) AS id, (event_id * event_id + 1) % (SELECT count(*) FROM documents) AS target, event_id // 3 % 8 AS k, event_id AS e FROM events
), ld AS (
  SELECT id, max(place) AS ld FROM ev WHERE k = 6 AND e % 5 = 1 GROUP BY id
), s0 AS (
  SELECT id, ld, min(place) FILTER (k = 7 AND place > ld) AS s0 FROM ld JOIN ev USING (id) GROUP BY ALL
), eff AS (
  SELECT ev.* FROM ev LEFT JOIN s0 USING (id) WHERE ld IS NULL OR place > s0
), fin AS (
  SELECT id, max_by('new text ' || e, place) FILTER (k = 2) AS content,
   max_by(CASE WHEN k = 3 THEN 'deprecated' WHEN e % 3 = 0 THEN 'verified' ELSE 'stale' END, place) FILTER (k = 1 OR k = 3 AND e % 5 = 0) AS confidence,
   max_by(CASE WHEN e % 2 = 0 THEN '{"a": ' || e || ', "b": 1}' ELSE '' END, place) FILTER (k = 4) AS metadata,
   list(DISTINCT 't-' || e % 3) FILTER (k = 5) AS tags, count(*) FILTER (k = 0) AS n,
   max(ts) FILTER (k IN (1, 2, 4) OR k = 3 AND e % 5 = 0) AS updated, max(ts) FILTER (k = 0 OR k = 3 AND e % 5 <> 0) AS accessed, max(ts) FILTER (k = 2 OR k = 1 AND e % 3 = 0) AS confirmed
  FROM eff GROUP BY id
), base AS (
  SELECT id, title, content, confidence, tags, access_count, updated_at, last_accessed, last_confirmed FROM memories ANTI JOIN ld USING (id)
  UNION ALL SELECT id, 'again', 'stored ' || e, CASE WHEN e % 2 = 0 THEN 'verified' ELSE 'inferred' END, [], 0, ts, ts, CASE WHEN e % 2 = 0 THEN ts END FROM s0 JOIN ev USING (id) WHERE place = s0
), er AS (
  SELECT id AS s, target AS t, 'caused_by' AS k, min(place) AS place FROM ev LEFT JOIN s0 a USING (id) LEFT JOIN s0 b ON b.id = target
  WHERE k = 6 AND e % 5 <> 1 AND ev.id <> target AND (a.ld IS NULL OR place > a.s0) AND (b.ld IS NULL OR place > b.s0) GROUP BY ALL
)
"""


@query(_REPLAYED + """SELECT b.id, b.title, md5(coalesce(f.content, b.content)) AS content_md5, coalesce(f.confidence, b.confidence) AS confidence, nullif(f.metadata, '') AS metadata,
 array_to_string(list_sort(list_distinct(list_concat(b.tags, coalesce(f.tags, [])))), ',') AS tags, b.access_count + coalesce(n, 0) AS access_count,
 epoch_us(coalesce(updated, b.updated_at)) AS updated, epoch_us(coalesce(accessed, b.last_accessed)) AS accessed, epoch_us(coalesce(confirmed, b.last_confirmed)) AS confirmed FROM base b LEFT JOIN fin f USING (id)""")
def change_log_replay(spark, sf_dir):
    """All memories after a log of stores, updates, deletions, accesses and tags in order."""
    df = memories(spark, sf_dir).withColumn("metadata", F.lit(None).cast("string"))
    done = replay.replayed(df, relations(spark, sf_dir), _log(spark, sf_dir))
    us = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c))
    return done.memories.select("id", "title", F.md5("content").alias("content_md5"), "confidence", "metadata", F.array_join(F.array_sort("tags"), ",").alias("tags"), "access_count", us("updated_at").alias("updated"), us("last_accessed").alias("accessed"), us("last_confirmed").alias("confirmed"))


@query(_REPLAYED + """SELECT edge_id, source_id, target_id, relation_type FROM relations ANTI JOIN ld ON ld.id = source_id ANTI JOIN ld x ON x.id = target_id
 UNION ALL SELECT place, s, t, k FROM er WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.source_id = s AND r.target_id = t AND r.relation_type = k AND NOT EXISTS (SELECT 1 FROM ld WHERE ld.id IN (s, t)))""")
def change_log_edges(spark, sf_dir):
    """All edges after the same log: related once, gone with their memories."""
    df = memories(spark, sf_dir).withColumn("metadata", F.lit(None).cast("string"))
    return replay.replayed(df, relations(spark, sf_dir), _log(spark, sf_dir)).relations.select("edge_id", "source_id", "target_id", "relation_type")


_CLAIMS_CHANGED = ", c AS (SELECT id AS memory_id, namespace, confidence, namespace || '#' || (id % 50) AS ref, CASE (id + CASE WHEN id % 10 = 3 THEN 1 ELSE 0 END) % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'open' ELSE 'unverified' END AS state FROM memories WHERE id % 10 <> 4) "


@query(_CLAIMS_CHANGED + """SELECT 'claim' AS kind, memory_id, namespace, ref, state FROM c
 UNION ALL SELECT 'contradicted', a.memory_id, a.namespace, a.ref, 'open' FROM c a WHERE a.state = 'open' AND a.confidence <> 'deprecated' AND EXISTS (SELECT 1 FROM c b WHERE b.namespace = a.namespace AND b.ref = a.ref AND b.state = 'resolved' AND b.confidence <> 'deprecated' AND b.memory_id <> a.memory_id)""")
def claims_incremental(spark, sf_dir):
    """Claims and contradictions after a tenth of the texts changed and a tenth of the memories went, from what moved alone."""
    df = views.claim_texts(spark, sf_dir)
    repo, active = F.col("namespace"), F.col("confidence") != "deprecated"
    old = saved(claims.extract(df, repo).withColumn("resolved_state", F.lit(None).cast("string")), "claims")
    before = claims.contradicted(old, df.where(active).select("id"))
    shifted = F.element_at(F.array(F.lit(" merged"), F.lit(" open"), F.lit("")), ((F.col("id") + 1) % 3 + 1).cast("int"))
    moved_rows = memories(spark, sf_dir).where("id % 10 = 3").withColumn("content", F.concat("content", F.lit("\nPR #"), (F.col("id") % 50).cast("string"), shifted))
    moved, gone = df.where("id % 10 = 3").select("id"), df.where("id % 10 = 4").select("id")
    new = saved(claims.synchronised(old, moved_rows, moved, gone, repo)[0], "claims")
    left = df.where(active & (F.col("id") % 10 != 4)).select("id")
    after = claims.contradicted_after(before, new, left, claims.touched_refs(old, new, moved.union(gone)))
    return new.select(F.lit("claim").alias("kind"), "memory_id", "namespace", "ref", "state").union(after.select(F.lit("contradicted"), "memory_id", "namespace", "ref", F.lit("open")))


# texts, transitions and the rest of the store, over all memories


def _us(c):
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c))


@query(r"""SELECT id, CASE WHEN length(flat) <= 200 THEN flat ELSE coalesce(nullif(regexp_extract(substr(flat, 1, 200), '^(.*) [^ ]*$', 1), ''), substr(flat, 1, 200)) || ' …' END AS excerpt,
 md5(title || chr(10) || chr(10) || content) AS input_md5, regexp_replace(lower(trim(title)), '\s+', '-', 'g') AS tag FROM (SELECT *, trim(regexp_replace(content, '\s+', ' ', 'g')) AS flat FROM memories) x""")
def text_shapes(spark, sf_dir):
    """Excerpts, what an encoder reads, and titles as tags."""
    return memories(spark, sf_dir).select("id", tx.excerpt(F.col("content")).alias("excerpt"), F.md5(tx.embedding_input(F.col("title"), F.col("content"))).alias("input_md5"), tx.normalised_tag(F.col("title")).alias("tag"))


@query("""SELECT id, CASE WHEN id % 4 = 0 THEN '{"a": "x", "b": ' || id || '}' END AS metadata FROM memories""")
def metadata_normalised(spark, sf_dir):
    given = F.element_at(F.array(F.concat(F.lit('{"b": '), F.col("id").cast("string"), F.lit(', "a": "x"}')), F.lit("[1]"), F.lit("bad{"), F.lit("")), (F.col("id") % 4 + 1).cast("int"))
    return memories(spark, sf_dir).select("id", tx.sorted_metadata(given).alias("metadata"))


@query("""SELECT id, confidence, access_count, pinned, last_confirmed IS NOT NULL AS confirmed, array_to_string(tags, ',') AS tags, epoch_us(created_at) AS created FROM memories
 UNION ALL SELECT id + 1000000000, confidence, 0, false, confidence = 'verified', array_to_string(tags, ',') || ',new-one', epoch_us(TIMESTAMP '2024-02-15') FROM memories WHERE id % 10 = 0""")
def create_memories(spark, sf_dir):
    df = memories(spark, sf_dir)
    fresh = df.where("id % 10 = 0").select((F.col("id") + 1_000_000_000).alias("id"), "namespace", "type", "title", "content", "confidence", F.concat("tags", F.array(F.lit(" New  One"), F.lit("new-one"))).alias("tags"))
    return state.created(df, fresh, now()).select("id", "confidence", "access_count", "pinned", F.col("last_confirmed").isNotNull().alias("confirmed"), F.array_join("tags", ",").alias("tags"), _us("created_at").alias("created"))


@query("SELECT id, CASE WHEN id % 6 = 1 THEN 'deprecated' ELSE confidence END AS confidence, epoch_us(CASE WHEN id % 6 = 1 THEN TIMESTAMP '2024-02-15' ELSE updated_at END) AS updated, epoch_us(last_accessed) AS accessed FROM memories")
def forget_memories(spark, sf_dir):
    df = memories(spark, sf_dir)
    return state.forgotten(df, df.where("id % 6 = 1").select("id"), now()).select("id", "confidence", _us("updated_at").alias("updated"), _us("last_accessed").alias("accessed"))


@query("""SELECT 'memory' AS kind, id FROM memories WHERE id % 9 <> 4 UNION ALL SELECT 'edge', edge_id FROM relations WHERE source_id % 9 <> 4 AND target_id % 9 <> 4
 UNION ALL SELECT 'access', log_id FROM access_log WHERE memory_id % 9 <> 4""")
def delete_memories(spark, sf_dir):
    df = memories(spark, sf_dir)
    left, edges, rest = state.deleted(df, relations(spark, sf_dir), {"log": views.access_log(spark, sf_dir)}, df.where("id % 9 = 4").select("id"))
    return left.select(F.lit("memory").alias("kind"), "id").union(edges.select(F.lit("edge"), "edge_id")).union(rest["log"].select(F.lit("access"), "log_id"))


@query("SELECT id, epoch_us(CASE WHEN id % 8 = 3 THEN TIMESTAMP '2024-02-15' ELSE last_accessed END) AS accessed, access_count FROM memories")
def touch_memories(spark, sf_dir):
    df = memories(spark, sf_dir)
    return state.touched(df, df.where("id % 8 = 3").select("id"), now()).select("id", _us("last_accessed").alias("accessed"), "access_count")


@query("""SELECT id, CASE WHEN id % 5 = 2 THEN array_to_string(list_concat(tags, ['new-tag']), ',') ELSE array_to_string(tags, ',') END AS added, CASE WHEN id % 5 = 2 THEN 'new-tag,' || tags[1] ELSE array_to_string(tags, ',') END AS replaced FROM memories""")
def tag_memories(spark, sf_dir):
    """Tags added to those there are, and put in their place."""
    df = memories(spark, sf_dir)
    tags = df.where("id % 5 = 2").select("id", F.array(F.lit(" New Tag"), F.get("tags", F.lit(0)), F.lit("new  tag")).alias("tags"))
    one, other = (state.tagged(df, tags, r).select("id", F.array_join("tags", ",").alias(n)) for r, n in ((False, "added"), (True, "replaced")))
    return one.join(other, "id")


@query("""SELECT source_id, target_id, relation_type, count(*) AS n FROM relations GROUP BY ALL
 UNION ALL SELECT DISTINCT target_id, source_id, 'related_to', 1 FROM relations r WHERE edge_id % 4 < 2 AND NOT EXISTS (SELECT 1 FROM relations o WHERE o.source_id = r.target_id AND o.target_id = r.source_id AND o.relation_type = 'related_to')""")
def relate_memories(spark, sf_dir):
    """New edges against the direction of old ones, self edges and some that are there already besides."""
    edges = relations(spark, sf_dir)
    own = edges.where("edge_id % 4 < 2")
    fresh = own.select((F.col("edge_id") + 1_000_000_000).alias("edge_id"), F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit("related_to").alias("relation_type"))
    fresh = fresh.union(own).union(own.select("edge_id", "source_id", "source_id", "relation_type"))
    return stats.by(state.related(edges, fresh), "source_id", "target_id", "relation_type")


@query("SELECT id, CASE WHEN id % 7 = 0 THEN 'stale' ELSE confidence END AS confidence FROM memories")
def upsert_memories(spark, sf_dir):
    """Newer versions of some rows, equal ones of the same, and older ones of others."""
    df = memories(spark, sf_dir).select("id", "confidence", "updated_at")
    days = lambda n: F.col("updated_at") + F.make_dt_interval(days=F.lit(n))
    new = df.where("id % 7 = 0").select("id", F.lit("stale").alias("confidence"), F.when(F.col("id") % 2 == 0, days(1)).otherwise(F.col("updated_at")).alias("updated_at"))
    return state.upserted(df, new.union(df.where("id % 7 = 1").select("id", F.lit("deprecated"), days(-1))), "id", "updated_at").select("id", "confidence")


@query("""SELECT kept AS source_id, id AS target_id, 'supersedes' AS relation_type FROM (SELECT id, arg_max(id, (crank, updated_at, -id)) OVER (PARTITION BY namespace, title) AS kept FROM scored) x WHERE id <> kept""")
def retire_originals(spark, sf_dir):
    """Edges from what is kept of equal titles to what it replaces."""
    df = _titled(memories(spark, sf_dir))
    kept = cluster.consolidated(df, "cluster", "deduplicate").select("cluster", "kept")
    return cluster.retired(df.select("id", "cluster").join(kept, "cluster"))


@query(_CLAIMS + "SELECT memory_id, ref, CASE WHEN ref IN ('src1#5', 'src0#10', 'nowhere#1') THEN 'resolved' END AS named, CASE WHEN state = 'open' THEN 'resolved' END AS every FROM c")
def claims_resolved(spark, sf_dir):
    """Named references marked resolved in whatever state, and all open ones."""
    found = claims.extract(views.claim_texts(spark, sf_dir), F.col("namespace")).withColumn("resolved_state", F.lit(None).cast("string"))
    one = claims.resolve(found, ["src1#5", "src0#10", "nowhere#1"]).withColumnRenamed("resolved_state", "named")
    return claims.resolve(one.withColumn("resolved_state", F.lit(None).cast("string")), "all").select("memory_id", "ref", "named", F.col("resolved_state").alias("every"))


@query("""SELECT count(*) AS total, count(*) FILTER (s < 0) AS expired, count(*) FILTER (s >= 0 AND s <= 14 * 86400) AS expiring_soon
 FROM (SELECT trunc((epoch_us(created_at + to_days(CAST(id % 60 AS INT))) - epoch_us(TIMESTAMP '2024-02-15')) / 1000000) AS s FROM memories) x""")
def credential_expiry(spark, sf_dir):
    services = memories(spark, sf_dir).select(F.col("title").alias("service"), (F.col("created_at") + F.make_dt_interval(days=(F.col("id") % 60).cast("int"))).alias("expires_at"))
    return stats.expiry(services, now())


@query(_REPAIRED + "SELECT outcome, count(*) AS n FROM (SELECT outcome FROM r1 UNION ALL SELECT outcome FROM r2 UNION ALL SELECT CASE WHEN n > 0 THEN 'deleted' ELSE 'not_found' END FROM r3) x GROUP BY outcome")
def edge_outcomes(spark, sf_dir):
    edges, ops = _repairs(spark, sf_dir)
    return stats.outcomes(repair.repaired(edges, ops)[1])


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'gone-' ELSE '' END || namespace AS namespace FROM memories")
def namespace_stamped(spark, sf_dir):
    """Names for namespace ids; an id that no namespace has stands for itself."""
    df = memories(spark, sf_dir).withColumn("namespace_id", F.concat(F.when(F.col("id") % 3 == 0, "gone-").otherwise("id-"), "namespace"))
    names = views.table(spark, sf_dir, "documents").select(F.concat(F.lit("id-"), "source").alias("id"), F.col("source").alias("name")).distinct()
    return namespaces.stamped(df, names).select("id", "namespace")


@query("""SELECT id, vector[1] AS first FROM vectors WHERE id % 2 = 0
 UNION ALL SELECT id, CAST(length(title) + 2 + length(content) AS DOUBLE) FROM (SELECT * FROM memories WHERE id NOT IN (SELECT id FROM vectors WHERE id % 2 = 0) ORDER BY id LIMIT 120) x""")
def embed_backfill(spark, sf_dir):
    """Vectors for the first memories that have none, by an encoder that tells a text's length."""
    have = views.embeddings(spark, sf_dir).where("id % 2 = 0")
    done = state.embedded(memories(spark, sf_dir), have, lambda texts: [[float(len(t))] + [0.0] * 63 for t in texts], 64, 120)
    return done.select("id", F.col("vector")[0].alias("first"))


@query("""SELECT 'memory' AS kind, id, CASE WHEN namespace IN ('src0', 'src1') THEN 'stale' ELSE confidence END AS of FROM memories
 UNION ALL SELECT 'edge', edge_id, relation_type FROM relations JOIN memories s ON s.id = source_id JOIN memories t ON t.id = target_id
 WHERE NOT (s.namespace IN ('src0', 'src1') OR t.namespace IN ('src0', 'src1'))
 UNION ALL SELECT 'edge', min(edge_id), relation_type FROM relations JOIN memories s ON s.id = source_id JOIN memories t ON t.id = target_id
 WHERE s.namespace IN ('src0', 'src1') AND t.namespace IN ('src0', 'src1') GROUP BY source_id, target_id, relation_type""")
def import_replaced(spark, sf_dir):
    """Two namespaces exported with another confidence and imported over those that are there: all rows afterwards."""
    df, edges = memories(spark, sf_dir), relations(spark, sf_dir)
    own, inner = portability.export_rows(df.where("namespace IN ('src0', 'src1')").withColumn("confidence", F.lit("stale")), edges)
    inner = inner.groupBy("source_id", "target_id", "relation_type").agg(F.min("edge_id").alias("edge_id")).select(edges.columns)
    path = new_path(spark, "export")
    portability.export_lines(own, inner, path)
    every, linked = portability.imported(df, edges, *portability.read_lines(spark, path, own.schema, inner.schema), "replace")
    return every.select(F.lit("memory").alias("kind"), "id", F.col("confidence").alias("of")).union(linked.select(F.lit("edge"), "edge_id", "relation_type"))


@query("""SELECT id, 'unmerged-branch' AS signals FROM scored WHERE id % 3 = 2 AND confidence <> 'deprecated' AND type NOT IN ('pattern', 'preference') AND age_days >= 14""")
def review_quoted(spark, sf_dir):
    """Dates within quotation marks and backticks give no signal."""
    text = F.element_at(F.array(F.lit('he wrote "expires 2024-01-10" there'), F.lit("`as of 2024-01-05`"), F.lit("the branch x is still open")), (F.col("id") % 3 + 1).cast("int"))
    df = memories(spark, sf_dir).withColumn("content", F.concat("content", F.lit("\n\n"), text))
    return review.sweep(df, now()).select("id", F.array_join("signals", ",").alias("signals"))
