"""Hybrid retrieval: BM25 and vector rankings fused by reciprocal rank.

One question on a corpus without an index takes one scan: the length and the query terms' frequencies of
each document are written as narrow rows, from which both the statistics and the scores follow.  With an index
(``postings``) nothing but the blocks of its terms is read.  Query terms and the query vector are literals.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep import schema as S
from lorekeep.functions.scoring import composite
from lorekeep.functions.text import porter, query_terms, stem, words
from lorekeep.operators import listing
from lorekeep.sources.tables import saved

if TYPE_CHECKING:
    from lorekeep.operators.postings import Index


def terms_of(query: str, stemmed: bool = False) -> list[str]:
    """The words of a query, or their stems, repeats kept."""
    return [porter(t) if stemmed else t for t in query_terms(query)]


def document_words(corpus: DataFrame) -> DataFrame:
    """(id, w): the words of title and content."""
    return corpus.select("id", words(F.concat_ws(" ", "title", "content")).alias("w"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(term, stem) of the distinct words of ``docs`` (id, w): each is stemmed once."""
    return docs.select(F.explode("w").alias("term")).distinct().withColumn("stem", stem("term"))


def idf(n, df) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def weighted(terms: Sequence[str], tf: Sequence[Column], length: Column, n: int, average: float, df: Sequence[int], k1: float = 1.2, b: float = 0.75) -> Column:
    """The score of a document: ``tf`` and ``df`` in the order of the distinct ``terms``, which are summed in that order."""
    norm = F.lit(k1) * (1.0 - b + b * length / F.lit(float(average or 1.0)))
    score = F.lit(0.0)
    for t, f, d in zip(dict.fromkeys(terms), tf, df, strict=True):
        f = f.cast("double")
        score = score + float(list(terms).count(t)) * idf(n, d) * f * (k1 + 1.0) / (f + norm)
    return score


def bm25(corpus: DataFrame, query: str, stemmed: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, bm25) of the rows that hold a query term; statistics are those of the whole corpus."""
    terms = terms_of(query, stemmed)
    distinct, docs = list(dict.fromkeys(terms)), document_words(corpus)
    if not terms:
        return docs.select("id", F.lit(0.0).alias("bm25")).limit(0)
    forms = {t: [t] for t in distinct}
    if stemmed:  # the words that the corpus has of a stem
        held = vocabulary(docs).where(F.col("stem").isin(distinct)).collect()
        forms = {t: [r["term"] for r in held if r["stem"] == t] for t in distinct}
    count = lambda t: F.size(F.filter("w", lambda w: w.isin(forms[t]) if forms[t] else F.lit(False)))
    counted = saved(docs.select("id", F.size("w").alias("dl"), F.array(*map(count, distinct)).alias("tf")), "terms")
    stats = counted.agg(F.count("*").alias("n"), F.sum("dl").alias("length"), *[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(distinct))]).first()
    average = (stats["length"] or 0) / stats["n"] if stats["n"] else 1.0
    score = weighted(terms, [F.col("tf")[i] for i in range(len(distinct))], F.col("dl"), stats["n"], average, [stats[f"df{i}"] for i in range(len(distinct))], k1, b)
    return counted.where(F.exists("tf", lambda x: x > 0)).select("id", score.alias("bm25"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for an empty, zero or differently long vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    norm = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot / norm).otherwise(0.0)


def vector_topk(embeddings: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """(id, similarity): the k most similar vectors, ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return embeddings.select("id", cosine(F.col("vector"), q).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Row numbers over a frame that a limit has bounded."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def fused(corpus: DataFrame, kept: DataFrame, embeddings: DataFrame | None, query: str, vector: Sequence[float] | None, limit: int, floor: float = S.ENTRY_FLOOR, stemmed: bool = False, index: Index | None = None) -> DataFrame:
    """(id, relevance) by reciprocal rank fusion.

    The keyword pool is the best ``max(COHORT, limit)`` of ``kept``; its first COHORT and up to ENTRANTS
    other vectors at or above ``floor`` are ranked by similarity.  What the pool ranks behind
    the cohort has no semantic rank.  At most a few hundred rows pass the windows.  With an ``index`` of the corpus
    the pool is read from it and ``corpus`` isn't read; whether words are stemmed is then the index's choice.
    """
    order = [F.desc("bm25"), F.col("id")]
    if index is not None and terms_of(query):
        best = index.top(query, max(S.COHORT, limit), kept)
    else:
        best = bm25(corpus, query, stemmed).join(kept.select("id"), "id", "left_semi").orderBy(*order).limit(max(S.COHORT, limit))
    pool = ranked(best, order, "bm25_rank")
    if vector is None or embeddings is None:
        return pool.select("id", ((S.RRF_K + 1.0) / (S.RRF_K + F.col("bm25_rank"))).alias("relevance"))
    q = F.array(*[F.lit(float(x)) for x in vector])
    near = embeddings.where(F.size("vector") == len(vector)).join(kept.select("id"), "id", "left_semi").select("id", cosine(F.col("vector"), q).alias("similarity"))
    pool = saved(pool, "pool")  # max(COHORT, limit) rows
    small = F.broadcast(pool.select("id", "bm25_rank")) if limit <= S.BROADCAST_ROWS else pool.select("id", "bm25_rank")
    cohort = near.join(small.where(F.col("bm25_rank") <= S.COHORT), "id").select("id", "similarity")
    fresh = near.join(small, "id", "left_anti").where(F.col("similarity") >= floor).orderBy(F.desc("similarity"), "id").limit(S.ENTRANTS)
    semantic = ranked(cohort.union(fresh.select("id", "similarity")), [F.desc("similarity"), F.col("id")], "semantic_rank").select("id", "semantic_rank")
    some = not near.isEmpty()
    best = (2.0 if some else 1.0) / (S.RRF_K + 1)
    part = lambda c: F.coalesce(1.0 / (S.RRF_K + F.col(c)), F.lit(0.0))
    both = pool.select("id", "bm25_rank").join(semantic, "id", "full_outer")
    return both.select("id", F.least(F.lit(1.0), (part("bm25_rank") + part("semantic_rank")) / best).alias("relevance"))


def hybrid(corpus: DataFrame, kept: DataFrame, embeddings: DataFrame | None, query: str, vector: Sequence[float] | None, now: Column, limit: int = 10, weights: dict | None = None, floor: float = S.ENTRY_FLOOR, stemmed: bool = False, index: Index | None = None) -> DataFrame:
    """The best ``limit`` of ``kept`` by composite score, ties by id.

    ``corpus`` gives the keyword statistics, or an ``index`` of it; ``kept`` (its filtered rows) the results.  Without
    ``weights`` the score is the fused relevance.
    """
    found = fused(corpus, kept, embeddings, query, vector, limit, floor, stemmed, index)
    full = kept.join(F.broadcast(found) if limit <= S.BROADCAST_ROWS else found, "id")
    score = composite(F.col("relevance"), now, weights) if weights is not None else F.col("relevance")
    return full.withColumn("score", score).orderBy(F.desc("score"), "id").limit(limit)


def matches_by(corpus: DataFrame, kept: DataFrame, query: str, column: str, limit: int, index: Index | None = None) -> DataFrame:
    """Rows that match any query term, the latest by ``column`` first."""
    hits = (index.bm25(query) if index is not None and terms_of(query) else bm25(corpus, query)).select("id")
    return kept.join(hits, "id", "left_semi").orderBy(F.col(column).desc(), "id").limit(limit)


def dispatched(corpus: DataFrame, kept: DataFrame, now: Column, query: str | None = None, sort_by: str = "relevance", limit: int = 10, embeddings: DataFrame | None = None, vector: Sequence[float] | None = None, weights: dict | None = None, floor: float = S.ENTRY_FLOOR, index: Index | None = None) -> DataFrame:
    """The search or listing that a query and an order ask for.

    With a query: by time, all that match it, latest first; else hybrid search.  Without one: by time, or by score.
    A query of white space alone is none.
    """
    if sort_by not in ("relevance", "decay_score", *listing.ORDERS):
        raise ValueError(f"unknown order: {sort_by}")
    asked = bool(query and query.strip())
    if sort_by in listing.ORDERS:
        return matches_by(corpus, kept, query, listing.ORDERS[sort_by], limit, index) if asked else listing.by_column(kept, sort_by, limit, now)
    return hybrid(corpus, kept, embeddings, query, vector, now, limit, weights, floor, index=index) if asked else listing.by_score(kept, limit, now, weights)


def batch_scores(corpus: DataFrame, questions: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(question, id, bm25) of all that holds a term of any of many questions (question, query), by an inverted join on terms."""
    asked = questions.select("question", F.explode(words(F.col("query"))).alias("term"))
    docs = document_words(corpus)
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl")).first()
    wanted = asked.select("term").distinct()
    postings = docs.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(wanted, "term").groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    part = idf(stats["n"], F.col("df")) * F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / float(stats["avgdl"] or 1.0)))
    return postings.join(df, "term").join(asked, "term").groupBy("question", "id").agg(F.round(F.sum(part), 9).alias("bm25"))


def batch_bm25(corpus: DataFrame, questions: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(question, rank, id, bm25): the ``k`` best for each of many questions."""
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("bm25"), "id"))
    return batch_scores(corpus, questions, k1, b).withColumn("rank", rank).where(F.col("rank") <= k)
