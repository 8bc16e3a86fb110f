"""Queries over the inverted index, ranked retrieval and its metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import curation, index, retrieval
from millrace.plans.catalog import query, table
from millrace.sources import tables

TERMS = [(1, "the"), (1, "that"), (1, "with"), (2, "pour"), (2, "dans"), (2, "une"), (3, "und"), (3, "nicht"), (3, "license")]
_TERMS = ", ".join(f"({q}, '{t}')" for q, t in TERMS)
TOK = r"tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]{2,}')) AS token FROM documents), post AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY ALL)"
BM25 = f"""WITH {TOK}, q(query_id, token) AS (VALUES {_TERMS}), len AS (SELECT doc_id, sum(tf) AS len FROM post GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM len)::DOUBLE / (SELECT count(*) FROM documents) AS a),
df AS (SELECT token, count(*) AS df FROM post WHERE token IN (SELECT token FROM q) GROUP BY 1),
sc AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))) AS score, sum(tf) AS hits, count(*) AS matched
  FROM post JOIN q USING (token) JOIN df USING (token) JOIN len USING (doc_id), st GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id DESC) AS rank FROM sc)"""
VEC = """vq AS (SELECT vec_id + 1 AS query_id, embedding AS query FROM embeddings WHERE vec_id < 3),
vs AS (SELECT query_id, vec_id, list_dot_product(embedding::DOUBLE[], query::DOUBLE[]) AS score FROM embeddings, vq),
de AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM vs)"""
RRF = f"""{BM25}, {VEC}, parts AS (SELECT query_id, doc_id AS item, rank, 0 AS list FROM bm WHERE rank <= 40 UNION ALL SELECT query_id, vec_id, rank, 1 FROM de WHERE rank <= 40),
fs AS (SELECT query_id, item, sum(1.0::DOUBLE / (60.0::DOUBLE + rank)) AS score, min(list * 1000 + rank) AS place FROM parts GROUP BY 1, 2),
fu AS (SELECT query_id, item, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, place) AS rank FROM fs)"""


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, "query_id long, token string")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = table(spark, sf_dir, "embeddings")
    return own, own.where("vec_id < 3").select((F.col("vec_id") + 1).alias("query_id"), F.col("embedding").alias("query"))


def ranked(spark: SparkSession, sf_dir: str, k: int = 40) -> DataFrame:
    """Over the stored index of the corpus, which the first search builds."""
    return retrieval.bm25(index.stored(spark, f"{sf_dir}/documents.parquet"), terms(spark), k)


def near(spark: SparkSession, sf_dir: str, k: int = 40) -> DataFrame:
    return retrieval.dense(*vectors(spark, sf_dir), k)


def fused(spark: SparkSession, sf_dir: str, k: int = 24) -> DataFrame:
    lists = [ranked(spark, sf_dir).withColumnRenamed("doc_id", "item"), near(spark, sf_dir).withColumnRenamed("vec_id", "item")]
    return retrieval.fuse(lists, k)


def _rows(df: DataFrame, *columns: str) -> DataFrame:
    out = df.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))
    return out.select(*columns)


@query(f"WITH {TOK} SELECT doc_id, token, tf FROM post")
def d03_term_freq(spark, sf_dir):
    return index.postings(table(spark, sf_dir, "documents"))


@query(f"WITH {TOK} SELECT token, count(*) AS df FROM post GROUP BY 1")
def d04_doc_freq(spark, sf_dir):
    return index.document_frequency(index.postings(table(spark, sf_dir, "documents")))


@query(f"WITH {TOK}, l AS (SELECT doc_id, sum(tf) AS n FROM post GROUP BY 1) SELECT (SELECT count(*) FROM documents) AS n, round((SELECT sum(n) FROM l)::DOUBLE / (SELECT count(*) FROM documents), 6) AS avg_len")
def d01_corpus_stats(spark, sf_dir):
    return index.statistics(table(spark, sf_dir, "documents")).withColumn("avg_len", F.round("avg_len", 6))


@query(f"WITH {TOK}, l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM post GROUP BY 1) SELECT round(avg(n), 6) AS avg_tokens, max(n) AS most FROM l")
def d02_two_level_avg(spark, sf_dir):
    own = index.lengths(index.postings(table(spark, sf_dir, "documents")))
    return own.agg(F.round(F.avg("token_count"), 6).alias("avg_tokens"), F.max("token_count").alias("most"))


@query(f"WITH {TOK}, l AS (SELECT doc_id, sum(tf) AS n FROM post GROUP BY 1) SELECT doc_id, token, tf, n::BIGINT AS token_count FROM post JOIN l USING (doc_id)")
def j16_index_rebuild(spark, sf_dir):
    """The postings of a stored index, read back."""
    return index.stored(spark, f"{sf_dir}/documents.parquet").postings.drop("bucket")


def _kept(spark: SparkSession) -> index.Segments:
    return index.Segments(spark, f"{tables.shared_dir(spark)}/millrace/segments-{uuid.uuid4().hex}")


def _by_token(own: index.Segments) -> DataFrame:
    return own.index().postings.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


@query(f"WITH {TOK} SELECT token, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM post GROUP BY 1")
def j15_index_restore(spark, sf_dir):
    """Documents arrive in two batches; those of one source are deleted; then the index goes back to what it was before."""
    docs, own = table(spark, sf_dir, "documents"), _kept(spark)
    own.add(docs.where("lang = 'en'"))
    whole = own.add(docs.where("lang IS DISTINCT FROM 'en'"))
    own.delete(docs.where("source = 'src0'"))
    own.restore(whole)
    return _by_token(own)


@query(r"""WITH kept AS (SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' revised edition' ELSE text END AS text FROM documents WHERE lang IS DISTINCT FROM 'es'),
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]{2,}')) AS token FROM kept), post AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY ALL)
SELECT token, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM post GROUP BY 1""")
def j16_incremental(spark, sf_dir):
    """Spanish documents are deleted and German ones replaced by a revision; then all segments become one."""
    docs, own = table(spark, sf_dir, "documents"), _kept(spark)
    own.add(docs)
    own.delete(docs.where("lang = 'es'"))
    own.add(docs.where("lang = 'de'").withColumn("text", F.concat("text", F.lit(" revised edition"))))
    own.merge()
    return _by_token(own)


@query(f"{BM25} SELECT query_id::BIGINT AS query_id, doc_id, round(score, 6) AS score, rank FROM bm WHERE rank <= 40")
def e01_bm25_top40(spark, sf_dir):
    return _rows(ranked(spark, sf_dir), "query_id", "doc_id", "score", "rank")


@query(f"{BM25} SELECT query_id::BIGINT AS query_id, doc_id, hits::BIGINT AS hits, matched::BIGINT AS matched FROM bm WHERE rank <= 20")
def e02_bm25_hits(spark, sf_dir):
    return ranked(spark, sf_dir, 20).select("query_id", "doc_id", "hits", "matched")


@query(f"WITH {VEC} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM de WHERE rank <= 40")
def e03_dense_topk(spark, sf_dir):
    return _rows(near(spark, sf_dir), "query_id", "vec_id", "score", "rank")


@query(f"WITH {VEC}, f AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM vs WHERE vec_id IN (SELECT vec_id FROM embeddings WHERE label = 3)) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM f WHERE rank <= 10")
def e04_dense_filtered(spark, sf_dir):
    own, queries = vectors(spark, sf_dir)
    return _rows(retrieval.dense_filtered(own, queries, own.where("label = 3").select("vec_id"), 10), "query_id", "vec_id", "score", "rank")


@query(f"{RRF} SELECT query_id::BIGINT AS query_id, item, round(score, 6) AS score, rank FROM fu WHERE rank <= 24")
def e05_rrf_fusion(spark, sf_dir):
    return _rows(fused(spark, sf_dir), "query_id", "item", "score", "rank")


@query(f"""{RRF} SELECT fu.query_id::BIGINT AS query_id, item, fu.rank, d.source, d.lang, round(bm.score, 6) AS bm25_score, round(de.score, 6) AS dense_score
FROM fu LEFT JOIN documents d ON d.doc_id = item LEFT JOIN bm ON bm.query_id = fu.query_id AND bm.doc_id = item AND bm.rank <= 40
LEFT JOIN de ON de.query_id = fu.query_id AND de.vec_id = item AND de.rank <= 40 WHERE fu.rank <= 24""")
def e06_hybrid_search(spark, sf_dir):
    """Fusion first, then both scores and the document's columns by left joins: an item without a document stays."""
    lexical = tables.stash(ranked(spark, sf_dir).select("query_id", F.col("doc_id").alias("item"), "score", "rank"), "lexical")  # 40 rows a query
    dense = tables.stash(near(spark, sf_dir).select("query_id", F.col("vec_id").alias("item"), "score", "rank"), "dense")
    best = retrieval.fuse([lexical, dense], 24).select("query_id", "item", F.col("rank").cast("long").alias("rank"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "source", "lang")
    bm = lexical.select("query_id", "item", F.round("score", 6).alias("bm25_score"))
    de = dense.select("query_id", "item", F.round("score", 6).alias("dense_score"))
    return docs.join(best, "item", "right").join(bm, ["query_id", "item"], "left").join(de, ["query_id", "item"], "left").select("query_id", "item", "rank", "source", "lang", "bm25_score", "dense_score")


@query(f"{BM25} SELECT query_id::BIGINT AS query_id, doc_id, rank, n_chars, substring(text, 1, 60) AS head FROM bm JOIN documents USING (doc_id) WHERE rank <= 24")
def e07_hydrate(spark, sf_dir):
    best = ranked(spark, sf_dir, 24).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.substring("text", 1, 60).alias("head"))
    return docs.join(best, "doc_id").select("query_id", "doc_id", "rank", "n_chars", "head")


@query(f"""{BM25}, c AS (SELECT query_id, doc_id, rank, n_chars FROM bm JOIN documents USING (doc_id) WHERE rank <= 24)
SELECT query_id::BIGINT AS query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, rank) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, rank) <= 5""")
def e08_rerank(spark, sf_dir):
    """A second score over the candidates (here their length), ties by the first rank."""
    best = ranked(spark, sf_dir, 24).select("query_id", "doc_id", F.col("rank").alias("first_rank"))
    own = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(best, "doc_id")
    return retrieval.top(own, 5, F.desc("n_chars"), F.asc("first_rank")).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(f"""{BM25}, s AS (SELECT query_id, doc_id, rank, source, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS k FROM bm JOIN documents USING (doc_id) WHERE rank <= 40)
SELECT query_id::BIGINT AS query_id, source, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM s WHERE k = 1""")
def e11_first_per_group(spark, sf_dir):
    best = ranked(spark, sf_dir).select("query_id", "doc_id", "rank")
    own = table(spark, sf_dir, "documents").select("doc_id", "source").join(best, "doc_id")
    return retrieval.first_per_group(own, "source").select("query_id", "source", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("""WITH e AS (SELECT event_id, user_id, 0.45 * greatest(0, value / 500.0) + 0.25 * (event_id % 7) / 7.0 + 0.15 * greatest(0, 1 - (epoch(TIMESTAMP '2024-02-01') - epoch(ts)) / 86400.0 / 365) + 0.15 * (event_id % 3) / 3.0 AS s FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, event_id) AS rank FROM e) SELECT user_id, event_id, round(s, 6) AS score, rank FROM r WHERE rank <= 3""")
def e12_weighted_rank(spark, sf_dir):
    """Weighted sum of similarity, importance, recency (now is a parameter) and confidence; three of each user."""
    days = (F.lit(1706745600.0) - F.unix_timestamp(F.col("ts").cast("timestamp")) - (F.date_format("ts", "SSSSSS").cast("double") / 1e6)) / 86400.0
    s = 0.45 * F.greatest(F.lit(0.0), F.col("value") / 500.0) + 0.25 * (F.col("event_id") % 7) / 7.0 + 0.15 * F.greatest(F.lit(0.0), 1 - days / 365) + 0.15 * (F.col("event_id") % 3) / 3.0
    own = table(spark, sf_dir, "events").select("user_id", "event_id", s.alias("score"))
    return _rows(retrieval.top(own, 3, F.desc(F.round("score", 9)), F.asc("event_id"), by="user_id"), "user_id", "event_id", "score", "rank")


@query(r"""WITH t AS (SELECT conv_id * 100 + turn AS id, regexp_replace(text, '[^\p{L}\p{N}_]', '', 'g') AS p FROM conversations), u AS (SELECT p, min(id) AS id FROM t WHERE length(p) >= 12 GROUP BY p),
g AS (SELECT id, length(p) AS n, list_distinct(list_transform(range(1, length(p) - 1), lambda i: substring(p, i, 3))) AS g FROM u),
c AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.g, b.g))::DOUBLE AS x, len(a.g) AS m, len(b.g) AS k FROM g a JOIN g b ON a.id < b.id AND least(a.n, b.n) >= 0.75 * greatest(a.n, b.n) AND least(len(a.g), len(b.g)) >= 0.75 * greatest(len(a.g), len(b.g)))
SELECT a, b, round(x / (m + k - x), 6) AS similarity FROM c WHERE x / (m + k - x) >= 0.75""")
def e16_near_dup(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return curation.near_duplicates(rows, "id").withColumn("similarity", F.round("similarity", 6))


@query(f"""{BM25}, r AS (SELECT DISTINCT q.query_id, l.doc_id FROM labels l, (SELECT DISTINCT query_id FROM q) q WHERE quality = 1), h AS (SELECT bm.query_id, rank, r.doc_id IS NOT NULL AS hit FROM bm LEFT JOIN r ON r.query_id = bm.query_id AND r.doc_id = bm.doc_id WHERE rank <= 40),
p AS (SELECT query_id, sum((hit AND rank <= 10)::INT) AS found, min(rank) FILTER (hit) AS first, sum(CASE WHEN hit AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM h GROUP BY 1), t AS (SELECT query_id, count(*) AS total FROM r GROUP BY 1)
SELECT query_id::BIGINT AS query_id, round(coalesce(found, 0)::DOUBLE / total, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(10, total) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM t LEFT JOIN p USING (query_id)""")
def e17_ir_metrics(spark, sf_dir):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").crossJoin(F.broadcast(ids))
    m = retrieval.metrics(ranked(spark, sf_dir), good, 10)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


@query(f"""{BM25}, c AS (SELECT query_id, max((doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))::INT) AS hit FROM bm WHERE rank <= 24 GROUP BY 1) SELECT round(avg(hit), 6) AS candidate_recall, count(*) AS queries FROM c""")
def e18_candidate_recall(spark, sf_dir):
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct().withColumn("hit", F.lit(1))
    per = ranked(spark, sf_dir, 24).join(bad, "doc_id", "left").groupBy("query_id").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return per.agg(F.round(F.avg("hit"), 6).alias("candidate_recall"), F.count("*").alias("queries"))


@query(r"""SELECT doc_id, CASE WHEN instr(text, 'License') > 0 THEN (CASE WHEN instr(text, 'License') > 41 THEN '...' ELSE '' END) || substring(text, greatest(instr(text, 'License') - 40, 1), least(instr(text, 'License') + 46, length(text)) - greatest(instr(text, 'License') - 40, 1) + 1) || (CASE WHEN instr(text, 'License') + 46 < length(text) THEN '...' ELSE '' END) END AS snippet FROM documents WHERE instr(text, 'License') > 0""")
def k03_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet("text", "License").alias("snippet")).where("snippet is not null")
