"""Ranked retrieval for batches of queries: BM25, exact dense top-k, rank fusion, re-ranking and roll-ups.

Queries come as tables, so a batch is one job. Ranking carries ids and scores only; texts are joined to the few rows
that remain. Top-k per query is row_number() <= k, which Spark prunes before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import tokens
from millrace.operators.index import Index, statistics

K1, B = 1.5, 0.75
RANK_CONSTANT = 60
MOST_QUERIES = 10_000  # rows of one broadcast batch


def top(scored: DataFrame, k: int, *order: Column, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """The first k rows of each query by the given order, ranked from 1."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= k)


def query_postings(docs: DataFrame, queries: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, token, tf, token_count) for the tokens of the queries (query_id, token) only.

    Counts are made within each row, so the corpus is never exploded and only matching rows leave the scan's tasks.
    """
    found = docs.select(id, tokens(text).alias("own")).withColumn("token_count", F.size("own").cast("long"))
    wanted = queries.select("token").distinct()
    hits = found.select(id, "token_count", F.explode("own").alias("token")).join(wanted, "token", "left_semi")
    return hits.groupBy(id, "token", "token_count").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame | Index, queries: DataFrame, k: int, id: str = "doc_id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score, hits, matched, rank): the top k by score, ties to the larger id (to nine places: sums come in any order).

    docs is a stored index, of which only the partitions of the queries' tokens are read, or a table, which is tokenised.
    """
    at_once = not isinstance(docs, Index)
    posted = query_postings(docs, queries, id, text) if at_once else docs.find(queries)
    figures = statistics(docs, id, text) if at_once else docs.statistics
    wanted = queries.distinct().join(posted.groupBy("token").agg(F.count("*").alias("df")), "token")
    if queries.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES:
        wanted = F.broadcast(wanted)  # no more rows than the batch: postings stay where they are read
    each = posted.join(wanted, "token").crossJoin(F.broadcast(figures))  # one row
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.when(F.col("avg_len") > 0, k1 * (1 - b + b * F.col("token_count") / F.col("avg_len"))).otherwise(k1)
    each = each.withColumn("part", idf * F.col("tf") * (k1 + 1) / (F.col("tf") + norm))
    scored = each.groupBy("query_id", id).agg(F.sum("part").alias("score"), F.sum("tf").alias("hits"), F.count("*").alias("matched"))
    return top(scored, k, F.desc(F.round("score", 9)), F.desc(id))


def dot(a, b) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense(vectors: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", metric: str = "dot") -> DataFrame:
    """(query_id, id, score, rank): exact top k of vectors (id, embedding) for queries (query_id, query).

    Each task keeps k rows a query before anything moves. The query batch is broadcast, so it may hold MOST_QUERIES rows;
    a caller with more runs several batches. Vectors of another length than a query's are an error there.
    """
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries in one batch")
    pairs = vectors.crossJoin(F.broadcast(queries))
    same = F.assert_true(F.size("embedding") == F.size("query"), F.lit("vectors of different lengths"))
    score = dot("embedding", "query")
    if metric == "cosine":
        score = score / F.sqrt(dot("embedding", "embedding") * dot("query", "query"))
    scored = pairs.select("query_id", id, F.when(same.isNull(), score).alias("score"))
    return top(scored, k, F.desc("score"), F.asc(id))


def dense_filtered(vectors: DataFrame, queries: DataFrame, allowed: DataFrame, k: int, id: str = "vec_id") -> DataFrame:
    """dense() among allowed ids only; the semi-join comes before any product."""
    return dense(vectors.join(allowed, id, "left_semi"), queries, k, id)


def fuse(lists: list[DataFrame], k: int, id: str = "item", constant: int = RANK_CONSTANT) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, item, rank) lists: (query_id, item, score, rank); ties keep the order of the lists."""
    parts = [x.select("query_id", id, "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    scored = both.groupBy("query_id", id).agg(F.sum(1.0 / (F.lit(float(constant)) + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("place"))
    return top(scored, k, F.desc("score"), F.asc("place.list"), F.asc("place.rank")).drop("place")


def first_per_group(ranked: DataFrame, group: str, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """The best-ranked row of each group within a query, ranked anew."""
    best = top(ranked.withColumnRenamed(rank, "_rank").withColumn("_key", F.struct(by, group)), 1, F.asc("_rank"), by="_key", rank=rank).drop("_key", rank)
    return top(best, 1 << 30, F.asc("_rank"), by=by, rank=rank).drop("_rank")


def metrics(ranked: DataFrame, relevant: DataFrame, k: int, id: str = "doc_id") -> DataFrame:
    """(query_id, recall, mrr, ndcg) of ranked (query_id, id, rank) against relevant (query_id, id); gains are binary."""
    hits = ranked.join(relevant.select("query_id", id).distinct().withColumn("hit", F.lit(1)), ["query_id", id], "left")
    total = relevant.groupBy("query_id").agg(F.countDistinct(id).alias("total"))
    near = F.col("hit").isNotNull() & (F.col("rank") <= k)
    per = hits.groupBy("query_id").agg(F.sum(F.when(near, 1).otherwise(0)).alias("found"), F.min(F.when(F.col("hit").isNotNull(), F.col("rank"))).alias("first"), F.sum(F.when(near, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("total").cast("int"))), F.lit(0.0), lambda s, x: s + 1 / F.log2(x + 1.0))
    return total.join(per, "query_id", "left").select("query_id", (F.coalesce("found", F.lit(0)) / F.col("total")).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))
