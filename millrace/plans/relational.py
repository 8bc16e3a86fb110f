"""Filters, joins, aggregations, ordering, paging, set operations and de-duplication over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import curation, evaluation, relational, retrieval
from millrace.plans.catalog import query, table

KEYWORDS = ("the", "license", "token", "pour", "nicht")
_ROUTES = "CASE WHEN o_totalprice < 1000 THEN 'too_small' WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderpriority LIKE '5%' THEN 'low_priority' END"


# Filters and predicates.
@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def b01_equality_filter(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice >= 1000")
def b02_optional_predicates(spark, sf_dir):
    """Only the parameters that are given become predicates."""
    return relational.filtered(table(spark, sf_dir, "orders"), status=("o_orderstatus", "=", "P"), least=("o_totalprice", ">=", 1000), before=None).select("o_orderkey")


@query("SELECT conv_id, turn FROM conversations WHERE turn > 1 AND turn <= 4")
def b05_range_predicate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("turn > 1 and turn <= 4").select("conv_id", "turn")


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'PROMO%'")
def b06_prefix(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_type").startswith("PROMO")).select("p_partkey", "p_type")


@query("SELECT doc_id, quality IS NOT NULL AS judged FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR trim(text) = '' OR text IS NULL")
def b07_empty_text(spark, sf_dir):
    """Documents that nobody judged, and those with nothing to judge."""
    own = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return own.where(F.col("quality").isNull() | (F.trim("text") == "") | F.col("text").isNull()).select("doc_id", F.col("quality").isNotNull().alias("judged"))


@query("SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND ((l.toxic = 0 AND d.n_chars > 200) OR (l.toxic = 1 AND d.n_chars > 5000)) AND d.lang IS NOT NULL")
def b08_eligibility_gate(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return own.where("quality = 1 and ((toxic = 0 and n_chars > 200) or (toxic = 1 and n_chars > 5000)) and lang is not null").select("doc_id")


def _reasons():
    return [(F.col("o_totalprice") < 1000, "too_small"), (F.col("o_orderstatus") == "F", "closed"), (F.col("o_orderpriority").startswith("5"), "low_priority")]


@query(f"SELECT o_orderkey, {_ROUTES} AS reason FROM orders")
def b09_first_reason(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.first_reason(*_reasons()).alias("reason"))


@query("SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice < 1000 THEN 'too_small' END, CASE WHEN o_orderstatus = 'F' THEN 'closed' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'low_priority' END) AS reasons FROM orders")
def b10_all_reasons(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(",", T.all_reasons(*_reasons())).alias("reasons"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 50")
def b11_case_order(spark, sf_dir):
    """The first 50 by a status order, then price."""
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    best = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", rank.alias("r")).orderBy("r", F.desc("o_totalprice"), "o_orderkey").limit(50)
    return best.select("o_orderkey", F.row_number().over(Window.orderBy("r", F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("place"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending FROM customer")
def b12_exists(spark, sf_dir):
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("pending", F.lit(True))
    return table(spark, sf_dir, "customer").select("c_custkey").join(pending, "c_custkey", "left").select("c_custkey", F.coalesce("pending", F.lit(False)).alias("pending"))


@query(f"SELECT doc_id, concat_ws(',', {', '.join(f"CASE WHEN contains(lower(text), '{k}') THEN '{k}' END" for k in KEYWORDS)}) AS labels FROM documents")
def b14_keyword_labels(spark, sf_dir):
    low = F.lower("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", T.all_reasons(*[(low.contains(k), k) for k in KEYWORDS])).alias("labels"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type END AS kind, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type NOT IN ('click', 'view', 'purchase') AS degraded FROM events")
def b16_enum_validation(spark, sf_dir):
    """A bad field becomes null and is reported; the row stays."""
    known = F.col("event_type").isin("click", "view", "purchase")
    return table(spark, sf_dir, "events").select("event_id", F.when(known, F.col("event_type")).alias("kind"), F.get_json_object("props", "$.k").try_cast("long").alias("k"), (~known).alias("degraded"))


@query("SELECT text AS duplicate, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def b17_duplicate_keys(spark, sf_dir):
    return relational.duplicates(table(spark, sf_dir, "documents"), "text").withColumnRenamed("text", "duplicate")


# Joins.
@query("SELECT l_orderkey, l_linenumber, o_custkey, c_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def c01_inner_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return lines.join(orders.join(customers, "o_custkey"), "l_orderkey").select("l_orderkey", "l_linenumber", "o_custkey", "c_nationkey")


@query("SELECT o_orderkey, coalesce(o_orderpriority, 'none') AS priority FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL AND o_orderstatus <> 'F'")
def c03_pending_anti(spark, sf_dir):
    failed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    return open_.join(failed, "o_orderkey", "left_anti").select("o_orderkey", F.coalesce("o_orderpriority", F.lit("none")).alias("priority"))


@query("SELECT count(*) AS orphans FROM embeddings LEFT JOIN documents ON vec_id = doc_id WHERE doc_id IS NULL")
def c04_orphans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf_dir, "embeddings").select("vec_id").join(docs, "vec_id", "left_anti").agg(F.count("*").alias("orphans"))


@query("SELECT DISTINCT user_id, c_mktsegment AS segment FROM events JOIN customer ON c_custkey = TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)")
def c05_json_join(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").try_cast("long").alias("c_custkey"))
    return own.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), "c_custkey").select("user_id", "segment").distinct()


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def c06_semi_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "n_chars")


@query("SELECT coalesce(a.id, b.id) AS id, a.orders, b.lines FROM (SELECT o_custkey AS id, count(*) AS orders FROM orders GROUP BY 1) a FULL JOIN (SELECT l_suppkey AS id, count(*) AS lines FROM lineitem GROUP BY 1) b ON a.id = b.id")
def c09_full_outer(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("orders"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("lines"))
    return a.join(b, "id", "full")


@query("SELECT d.doc_id, coalesce(b.text, d.text) = d.text AS own, length(coalesce(b.text, d.text)) AS size FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def c10_overlay(spark, sf_dir):
    """A replacement with the same id wins."""
    new = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("new"))
    best = F.coalesce("new", "text")
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(new, "doc_id", "left").select("doc_id", (best == F.col("text")).alias("own"), F.length(best).cast("long").alias("size"))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' ELSE 'both' END AS state FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def c11_coverage(spark, sf_dir):
    return relational.coverage(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id")


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1")
def c17_join_count(spark, sf_dir):
    own = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz '1997-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return own.join(table(spark, sf_dir, "customer"), "c_custkey").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@query("SELECT e.event_id, CASE WHEN c.c_custkey IS NULL THEN 'source_missing' WHEN c.c_acctbal < 0 THEN 'source_refused' END AS reason FROM events e LEFT JOIN customer c ON c.c_custkey = TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)")
def c19_source_validation(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    source = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal", F.lit(True).alias("there"))
    return own.join(source, "k", "left").select("event_id", T.first_reason((F.col("there").isNull(), "source_missing"), (F.col("c_acctbal") < 0, "source_refused")).alias("reason"))


# Aggregations.
@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def d05_group_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, count(DISTINCT l_suppkey || ':' || l_returnflag) AS kinds FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey || ':' || l_returnflag) > 3")
def d06_having_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct(F.concat_ws(":", "l_suppkey", "l_returnflag")).alias("kinds")).where("kinds > 3")


@query("SELECT count(*) AS n FROM (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) > 2)")
def d07_nested_having(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").count().where("count > 2").agg(F.count("*").alias("n"))


@query("SELECT conv_id, max(turn) + 1 AS next_turn FROM conversations GROUP BY 1")
def d08_next_sequence(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.coalesce(F.max("turn"), F.lit(-1)) + 1).alias("next_turn"))


@query(f"WITH t AS (SELECT doc_id, unnest(list_filter(['{"', '".join(KEYWORDS)}'], lambda k: contains(lower(text), k))) AS tag FROM documents) SELECT coalesce(tag, '<none>') AS tag, count(*) AS n FROM documents LEFT JOIN t USING (doc_id) GROUP BY 1")
def d09_tag_counts(spark, sf_dir):
    low = F.lower("text")
    tags = T.all_reasons(*[(low.contains(k), k) for k in KEYWORDS])
    return table(spark, sf_dir, "documents").select(F.explode_outer(tags).alias("tag")).groupBy(F.coalesce("tag", F.lit("<none>")).alias("tag")).agg(F.count("*").alias("n"))


@query("SELECT user_id, count(DISTINCT event_type) AS types, count(DISTINCT props) AS props FROM events GROUP BY 1")
def d10_distinct_size(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("types"), F.countDistinct("props").alias("props"))


@query("SELECT source, round(sum((n_chars > 1000)::INT) / greatest(1, count(*)), 6) AS long_rate, sum((lang = 'en')::INT)::BIGINT AS english FROM documents GROUP BY 1")
def d11_conditional_rate(spark, sf_dir):
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(count(F.col("n_chars") > 1000) / F.greatest(F.lit(1), F.count("*")), 6).alias("long_rate"), count(F.col("lang") == "en").alias("english"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM events GROUP BY 1")
def d12_mean_median(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"))


_PERCENTILE = "SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL"


@query(f"SELECT event_type, max(value) FILTER (place = least(n - 1, floor(n * 0.95)) + 1) AS floor_of_n, max(value) FILTER (place = floor((n - 1) * 0.95) + 1) AS floor_of_last, max(value) FILTER (place = ceil(n * 0.95)) AS nearest_rank FROM ({_PERCENTILE}) GROUP BY 1")
def d13_percentiles(spark, sf_dir):
    n = F.col("n")
    places = {"floor_of_n": F.least(n - 1, F.floor(n * 0.95)) + 1, "floor_of_last": F.floor((n - 1) * 0.95) + 1, "nearest_rank": F.ceil(n * 0.95)}
    return evaluation.percentiles_at(table(spark, sf_dir, "events"), ["event_type"], "value", places)


@query("SELECT event_type, min(value) AS least, max(value) AS most, arg_min(value, event_id) AS first, count(*) AS n FROM events GROUP BY 1")
def d14_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.min_by("value", "event_id").alias("first"), F.count("*").alias("n"))


@query(r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]{2,}')) AS token FROM documents), c AS (SELECT token, count(*) AS n, min(doc_id) AS first FROM t GROUP BY 1) SELECT token, n, row_number() OVER (ORDER BY n DESC, first, token) AS place FROM c QUALIFY place <= 30")
def d15_top_tokens(spark, sf_dir):
    """The 30 most frequent tokens, ties to the one seen first."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens("text")).alias("token"))
    best = own.groupBy("token").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).orderBy(F.desc("n"), "first", "token").limit(30)
    return best.select("token", "n", F.row_number().over(Window.orderBy(F.desc("n"), "first", "token")).cast("long").alias("place"))


@query("SELECT doc_id, (length(text) - length(replace(text, 'en', ''))) // 2 AS n FROM documents")
def d16_occurrences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.occurrences("text", "en").alias("n"))


@query(r"WITH p AS (SELECT regexp_replace(text, '\s', '', 'g') AS p FROM conversations WHERE role = 'user'), g AS (SELECT unnest(list_transform(range(1, length(p) - 1), lambda i: substring(p, i, 3))) AS gram FROM p WHERE length(p) >= 3) SELECT gram, count(*) AS n FROM g WHERE NOT regexp_matches(gram, '[^\p{L}\p{N}]') GROUP BY 1")
def d17_trigrams(spark, sf_dir):
    """Character trigrams within each row; those that hold punctuation are left out."""
    own = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.regexp_replace("text", r"\s", "").alias("p")).where(F.length("p") >= 3)
    grams = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("p") - 2), lambda i: F.substring("p", i, F.lit(3)))).alias("gram"))
    return grams.where(~F.col("gram").rlike(r"[^\p{L}\p{N}]")).groupBy("gram").agg(F.count("*").alias("n"))


@query(r"SELECT sum(n - 1)::BIGINT AS excess, count(*) AS keys FROM (SELECT lower(regexp_replace(text, '\s+', '', 'g')) AS k, count(*) AS n FROM documents GROUP BY 1)")
def d18_dup_excess(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(T.key("text").alias("k")).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("excess"), F.count("*").alias("keys"))


@query("SELECT source, round(avg((lang = 'en')::INT), 6) AS en, round(avg((lang = 'de')::INT), 6) AS de, round(avg((lang = 'fr')::INT), 6) AS fr FROM documents GROUP BY 1")
def d19_pivot_rates(spark, sf_dir):
    rate = lambda lang: F.round(F.avg((F.col("lang") == lang).cast("int")), 6).alias(lang)
    return table(spark, sf_dir, "documents").groupBy("source").agg(*[rate(x) for x in ("en", "de", "fr")])


@query(r"SELECT coalesce(nullif(regexp_extract(url, '(20\d{2})', 1), ''), 'unknown') AS year, count(*) AS n FROM pages GROUP BY 1")
def d20_year_bucket(spark, sf_dir):
    year = F.regexp_extract("url", r"(20\d{2})", 1)
    return table(spark, sf_dir, "pages").groupBy(F.when(year != "", year).otherwise("unknown").alias("year")).agg(F.count("*").alias("n"))


@query("SELECT user_id, round(sum(value), 6) AS total, CASE WHEN count(value) > 0 AND count(json_extract_string(props, '$.k')) > 0 THEN 'available' ELSE 'unavailable' END AS status FROM events GROUP BY 1")
def d21_usage_sum(spark, sf_dir):
    there = (F.count("value") > 0) & (F.count(F.get_json_object("props", "$.k")) > 0)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("total"), F.when(there, "available").otherwise("unavailable").alias("status"))


@query("SELECT o_orderstatus || ':' || o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 1")
def d22_composite_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.concat_ws(":", "o_orderstatus", "o_orderpriority").alias("key")).agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT doc_id, quality AS x FROM labels), b AS (SELECT doc_id, (n_chars > 500)::INT AS y FROM documents) SELECT count(*) AS shared, round(avg((x = y)::INT), 6) AS agreement FROM a JOIN b USING (doc_id)")
def d23_agreement(spark, sf_dir):
    a = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("x"))
    b = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("y"))
    return a.join(b, "doc_id").agg(F.count("*").alias("shared"), F.round(F.avg((F.col("x") == F.col("y")).cast("int")), 6).alias("agreement"))


@query("WITH e AS (SELECT event_type AS new, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events) SELECT old, new, count(*) AS n FROM e WHERE old IS NOT NULL GROUP BY ALL")
def d24_transitions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = table(spark, sf_dir, "events").select(F.lag("event_type").over(w).alias("old"), F.col("event_type").alias("new"))
    return own.where("old is not null").groupBy("old", "new").agg(F.count("*").alias("n"))


@query("WITH x AS (SELECT source, quality = 1 AS gold, n_chars > 500 AS guess FROM documents JOIN labels USING (doc_id)), c AS (SELECT source, sum((gold AND guess)::INT)::BIGINT AS tp, sum((NOT gold AND guess)::INT)::BIGINT AS fp, sum((gold AND NOT guess)::INT)::BIGINT AS fn FROM x GROUP BY 1), p AS (SELECT *, tp / greatest(1, tp + fp) AS p, tp / greatest(1, tp + fn) AS r FROM c) SELECT source, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(1e-4, p + r), 6) AS f1 FROM p")
def d25_f1(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    found = evaluation.confusion(own, F.col("quality") == 1, F.col("n_chars") > 500, "source")
    return found.select("source", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def d27_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


# Ordering, paging, sets and de-duplication.
@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def g01_order_limit(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20)


@query("WITH p AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01') SELECT o_orderkey, (SELECT max(n) FROM p) > 25 AS has_more FROM p WHERE n <= 25")
def g02_keyset_page(spark, sf_dir):
    """The page of 25 after a cursor, and whether more follow."""
    from datetime import datetime

    from millrace.operators import state

    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return state.page(own, "o_orderdate", "o_orderkey", 25, (datetime(1996, 1, 1), -1)).select("o_orderkey", "has_more")


@query("SELECT user_id, arg_max(event_id, {'a': ts, 'b': event_id}) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def g04_latest_version(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, min(event_id) AS event_id FROM events GROUP BY ALL")
def i02_last_wins(spark, sf_dir):
    own = table(spark, sf_dir, "events").withColumn("k", F.struct("user_id", "event_type"))
    return curation.last_wins(own, "k", "event_id", "value").select("k.user_id", "k.event_type", "value", "event_id")


@query("SELECT user_id, event_type, arg_max(event_id, {'v': value, 'o': -event_id}) AS event_id FROM events GROUP BY ALL")
def i04_max_weight_wins(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))


@query(r"SELECT min(doc_id) AS doc_id FROM documents WHERE n_chars >= 100 GROUP BY lower(regexp_replace(text, '\s+', '', 'g'))")
def i05_norm_dedup(spark, sf_dir):
    """The first document of each normalised text among those long enough: a short one does not reserve the text."""
    own = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2(T.key("text"), 256).alias("k"))
    return curation.first_of(own, ["k"], F.asc("doc_id"), where=F.col("n_chars") >= 100).select("doc_id")


@query("(SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE toxic = 1) INTERSECT SELECT vec_id FROM embeddings")
def i06_set_operations(spark, sf_dir):
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").subtract(bad).intersect(table(spark, sf_dir, "embeddings").select("vec_id"))


@query("SELECT doc_id AS id, 'documents' AS origin, lang FROM documents UNION ALL SELECT item_id, 'benchmark', NULL FROM benchmark")
def i08_union_with_origin(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("origin"), "lang")
    return a.unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("origin")), allowMissingColumns=True)


@query(r"SELECT doc_id FROM documents WHERE lower(regexp_replace(text, '\s+', '', 'g')) NOT IN (SELECT lower(regexp_replace(text, '\s+', '', 'g')) FROM benchmark WHERE text IS NOT NULL) OR text IS NULL")
def i10_decontaminate(spark, sf_dir):
    return curation.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id")


@query(f"SELECT coalesce({_ROUTES}, 'eligible') AS reason, count(*) AS n FROM orders GROUP BY 1")
def l08_funnel(spark, sf_dir):
    return curation.funnel(table(spark, sf_dir, "orders").withColumn("reason", T.first_reason(*_reasons())), "reason")


# Pairwise evaluation over order lines: the two sides of a comparison are a line's position in its order.
def _judgments(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    winner = F.when(F.col("l_quantity") > 33, "left").when(F.col("l_quantity") > 16, "right").otherwise("tie")
    return lines.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("case_id"), winner.alias("winner"))


_JUDGED = "SELECT l_orderkey AS case_id, CASE WHEN l_quantity > 33 THEN 'left' WHEN l_quantity > 16 THEN 'right' ELSE 'tie' END AS winner FROM lineitem WHERE l_linenumber <= 2"


@query(f"SELECT case_id, CASE WHEN count(*) < 2 THEN 'incomplete' WHEN count(DISTINCT winner) = 1 THEN min(winner) ELSE 'inconsistent' END AS verdict FROM ({_JUDGED}) GROUP BY 1")
def l02_consistency(spark, sf_dir):
    return evaluation.consistency(_judgments(spark, sf_dir), "case_id", "winner")


@query(f"SELECT case_id, round(avg(CASE winner WHEN 'left' THEN 1 WHEN 'right' THEN -1 ELSE 0 END), 6) AS effect FROM ({_JUDGED}) GROUP BY 1")
def l03_directional_effect(spark, sf_dir):
    side = F.when(F.col("winner") == "left", 1).when(F.col("winner") == "right", -1).otherwise(0)
    return _judgments(spark, sf_dir).groupBy("case_id").agg(F.round(F.avg(side), 6).alias("effect"))


@query("SELECT l_returnflag AS variant, dimension, round(avg(score), 6) AS mean FROM (SELECT l_returnflag, unnest(['discount', 'quantity', 'tax']) AS dimension, unnest([l_discount, l_quantity, l_tax]) AS score FROM lineitem) GROUP BY ALL")
def l05_score_means(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("variant"), F.col("l_discount").alias("discount"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    return own.unpivot("variant", ["discount", "quantity", "tax"], "dimension", "score").groupBy("variant", "dimension").agg(F.round(F.avg("score"), 6).alias("mean"))


@query()
def f17_bootstrap(spark, sf_dir):
    """A 95 % interval of the mean event value by resampling users."""
    return evaluation.bootstrap(table(spark, sf_dir, "events"), "value", "user_id")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def q01_pricing_summary(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return own.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def q05_nation_revenue(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    customers = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("part"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name").agg(F.round(F.sum("part"), 2).alias("revenue"))


@query("SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3")
def e08_top_per_source(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return retrieval.top(own, 3, F.desc("n_chars"), F.asc("doc_id"), by="source").select("source", "doc_id", F.col("rank").cast("long").alias("rank"))
