"""Lookups, lifecycles, selections, gates and reports: the smaller operators, one query each."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import curation, decode, export, retrieval, state
from millrace.plans.catalog import query, table
from millrace.sources import store, tables




@query("SELECT event_id FROM events WHERE ('global' = 'global' OR user_id = 7) AND event_type IN ('error', 'purchase')")
def b04_in_list(spark, sf_dir):
    """A short list of literals is a filter; a long one is a semi-join (c06)."""
    scope = "global"
    return table(spark, sf_dir, "events").where((F.lit(scope) == "global") | (F.col("user_id") == 7)).where(F.col("event_type").isin("error", "purchase")).select("event_id")


@query("SELECT c_custkey, CASE WHEN n > 0 THEN 'has_pending' ELSE 'none' END AS probe FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def b13_existence_probe(spark, sf_dir):
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(pending, "c_custkey", "left").select("c_custkey", F.when(F.col("n") > 0, "has_pending").otherwise("none").alias("probe"))


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'unknown_owner' WHEN c_nationkey <> 3 THEN 'foreign_owner' END AS problem FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_custkey IS NULL OR c_nationkey <> 3")
def b15_ownership(spark, sf_dir):
    """Rows whose owner is missing or another one."""
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", F.lit(True).alias("there"))
    problem = T.first_reason((F.col("there").isNull(), "unknown_owner"), (F.col("c_nationkey") != 3, "foreign_owner"))
    return table(spark, sf_dir, "orders").join(owners, "o_custkey", "left").select("o_orderkey", problem.alias("problem")).where("problem is not null")


@query("SELECT count(*) AS collisions FROM documents JOIN benchmark ON doc_id = item_id")
def c07_collisions(spark, sf_dir):
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").join(ids, "doc_id").agg(F.count("*").alias("collisions"))


@query("WITH s AS (SELECT l_orderkey AS key, l_linenumber AS n, (l_quantity * 10)::BIGINT AS s, (l_quantity * 10 + 20 * l_linenumber)::BIGINT AS e FROM lineitem) SELECT DISTINCT a.key, a.n::BIGINT AS n FROM s a WHERE EXISTS (SELECT 1 FROM s b WHERE b.key = a.key AND b.n <> a.n AND b.s <= a.s AND a.e <= b.e)")
def c12_span_containment(spark, sf_dir):
    """Spans inside another span of their key."""
    start = (F.col("l_quantity") * 10).cast("long")
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("long").alias("n"), start.alias("s"), (F.col("l_quantity") * 10 + 20 * F.col("l_linenumber")).cast("long").alias("e"))
    b = a.select("key", F.col("n").alias("n2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    inside = (F.col("n") != F.col("n2")) & (F.col("s2") <= F.col("s")) & (F.col("e") <= F.col("e2"))
    return a.join(b, "key").where(inside).select("key", "n").distinct()


@query("SELECT user_id, string_agg(k || ':' || CASE WHEN c_custkey IS NULL THEN 'missing' ELSE 'found' END, ',' ORDER BY k) AS sources FROM (SELECT DISTINCT user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) LEFT JOIN customer ON c_custkey = k WHERE k IS NOT NULL GROUP BY 1")
def c18_source_list(spark, sf_dir):
    """The sources each user names, with whether they exist."""
    own = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").try_cast("long").alias("k")).where("k is not null").distinct()
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("found").alias("state"))
    each = own.join(known, "k", "left").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("state", F.lit("missing")).alias("state")))).alias("x"))
    return each.select("user_id", F.array_join(F.transform("x", lambda r: F.concat_ws(":", r["k"].cast("string"), r["state"])), ",").alias("sources"))


@query("WITH g AS (SELECT doc_id, unnest(['quality', 'toxic']) AS signal, unnest([quality, toxic]) AS gold FROM labels), a AS (SELECT doc_id, unnest(['quality', 'toxic']) AS signal, unnest([(n_chars > 500)::INT, contains(text, '!!!')::INT]) AS found FROM documents) SELECT signal, count(*) AS cases, round(avg((gold = found)::INT), 6) AS accuracy, sum((gold <> found)::INT)::BIGINT AS misses FROM g JOIN a USING (doc_id, signal) GROUP BY 1")
def d26_signal_accuracy(spark, sf_dir):
    gold = table(spark, sf_dir, "labels").unpivot("doc_id", ["quality", "toxic"], "signal", "gold")
    found = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("quality"), F.col("text").contains("!!!").cast("int").alias("toxic")).unpivot("doc_id", ["quality", "toxic"], "signal", "found")
    both = gold.join(found, ["doc_id", "signal"])
    return both.groupBy("signal").agg(F.count("*").alias("cases"), F.round(F.avg((F.col("gold") == F.col("found")).cast("int")), 6).alias("accuracy"), F.sum((F.col("gold") != F.col("found")).cast("int")).alias("misses"))


@query("WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE lang = 'en' QUALIFY rank <= 8), d AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY label DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 8) SELECT doc_id, min(origin) AS origin FROM (SELECT doc_id, 'a_ranked' AS origin FROM s UNION ALL SELECT doc_id, 'b_seed' FROM d) GROUP BY 1")
def e15_seed_injection(spark, sf_dir):
    """Seeds join the ranked hits; what both hold keeps the ranked origin."""
    hits = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(8).select("doc_id", F.lit("a_ranked").alias("origin"))
    seeds = table(spark, sf_dir, "embeddings").orderBy(F.desc("label"), "vec_id").limit(8).select(F.col("vec_id").alias("doc_id"), F.lit("b_seed").alias("origin"))
    return hits.unionByName(seeds).groupBy("doc_id").agg(F.min("origin").alias("origin"))


@query("SELECT source, avg((quality = 1)::INT) >= 0.5 AND count(*) >= 5 AS passed, count(*) AS labelled FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def e19_quality_gate(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return own.groupBy("source").agg(((F.avg((F.col("quality") == 1).cast("int")) >= 0.5) & (F.count("*") >= 5)).alias("passed"), F.count("*").alias("labelled"))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority = '5-LOW')::INT, abs(o_totalprice - 100000), o_orderkey) = 1")
def e20_best_asset(spark, sf_dir):
    """The first by penalty, distance to a wanted size and id among those allowed."""
    own = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey", (F.col("o_orderpriority") == "5-LOW").cast("int").alias("p"), F.abs(F.col("o_totalprice") - 100000).alias("d"))
    return retrieval.top(own, 1, F.asc("p"), F.asc("d"), F.asc("o_orderkey"), by="o_custkey").select("o_custkey", "o_orderkey")


@query("SELECT conv_id, turn, array_to_string(list(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ',') AS sizes FROM conversations")
def f07_last_values(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 0)
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.collect_list(F.length("text").cast("string")).over(w).alias("x"))
    return own.select("conv_id", "turn", F.array_join("x", ",").alias("sizes"))


@query("WITH s AS (SELECT *, value - lag(value, 1, value) OVER w AS step, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS ahead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, round(step, 6) AS step, ahead FROM s")
def f14_envelope(spark, sf_dir):
    """The step to each value and the largest one among it and the next two."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = F.col("value") - F.coalesce(F.lag("value").over(w), F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", F.round(step, 6).alias("step"), F.max("value").over(w.rowsBetween(0, 2)).alias("ahead"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def g03_newest_after(spark, sf_dir):
    """Paging from a starting point keeps the newest first."""
    own = table(spark, sf_dir, "orders").where("o_orderdate > timestamp_ntz '1997-06-01'")
    return own.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select("o_orderkey")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY (role = 'user')::INT DESC, contains(text, '?')::INT DESC, length(text) DESC, turn) AS place FROM conversations")
def g06_priority_order(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy(F.desc(F.col("role") == "user"), F.desc(F.col("text").contains("?")), F.desc(F.length("text")), "turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT DISTINCT ON (l_orderkey, l_partkey) l_orderkey, l_partkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_partkey, l_linenumber")
def g08_idempotent_insert(spark, sf_dir):
    """Each segment once, the first by place."""
    return curation.first_of(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey", "l_partkey"], F.asc("l_linenumber"))


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL")
def i03_first_wins(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.min_by("value", "event_id").alias("value"))


@query(r"WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]{2,}')) AS t FROM documents) SELECT doc_id, list_has_any(t, ['the', 'die', 'les']) AS shares, list_has_all(t, ['the', 'and']) AS covers FROM t")
def i07_array_tests(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(T.tokens("text")).alias("t"))
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    return own.select("doc_id", F.arrays_overlap("t", words("the", "die", "les")).alias("shares"), (F.size(F.array_except(words("the", "and"), "t")) == 0).alias("covers"))


@query(r"SELECT c.conv_id, c.turn FROM conversations c WHERE c.role = 'user' AND NOT EXISTS (SELECT 1 FROM documents d WHERE lower(regexp_replace(d.text, '\s+', '', 'g')) = lower(regexp_replace(c.text, '\s+', '', 'g')))")
def i09_input_exclusion(spark, sf_dir):
    return curation.decontaminate(table(spark, sf_dir, "conversations").where("role = 'user'"), table(spark, sf_dir, "documents")).select("conv_id", "turn")


@query("SELECT c_custkey, n.total IS NOT NULL AND n.total <> c_acctbal AS changed, CASE WHEN n.total IS NOT NULL AND n.total <> c_acctbal THEN 'pending' ELSE c_mktsegment END AS segment FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS total FROM orders GROUP BY 1) n ON o_custkey = c_custkey")
def j04_edit_resets(spark, sf_dir):
    """A changed content resets a derived field; an equal one keeps it."""
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("total"))
    changed = F.col("total").isNotNull() & (F.col("total") != F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").join(new, "c_custkey", "left").select("c_custkey", changed.alias("changed"), F.when(changed, "pending").otherwise(F.col("c_mktsegment")).alias("segment"))


@query("WITH c AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') SELECT o_orderkey AS id, 'superseded' AS status FROM orders JOIN c USING (o_custkey) WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, 'closed' FROM c")
def j05_close(spark, sf_dir):
    """Closing a key supersedes its open rows and adds one closed row."""
    orders = table(spark, sf_dir, "orders")
    keys = orders.where("o_orderstatus = 'P'").select("o_custkey").distinct()
    old = orders.where("o_orderstatus = 'O'").join(keys, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("id"), F.lit("superseded").alias("status"))
    return old.unionByName(keys.select(F.col("o_custkey").alias("id"), F.lit("closed").alias("status")))


@query("SELECT user_id, string_agg(DISTINCT CASE event_type WHEN 'error' THEN 'tombstone' WHEN 'purchase' THEN 'kept' ELSE 'seen' END, ',' ORDER BY CASE event_type WHEN 'error' THEN 'tombstone' WHEN 'purchase' THEN 'kept' ELSE 'seen' END) AS labels FROM events GROUP BY 1")
def j07_annotations(spark, sf_dir):
    name = F.when(F.col("event_type") == "error", "tombstone").when(F.col("event_type") == "purchase", "kept").otherwise("seen")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias("labels"))


@query("""WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1), a AS (SELECT conv_id, last FROM l WHERE conv_id % 3 = 0 UNION ALL SELECT conv_id + 100000, -1 FROM l WHERE conv_id % 5 = 0)
SELECT conv_id, turn, role FROM conversations UNION ALL SELECT conv_id, last + 1, 'user' FROM a UNION ALL SELECT conv_id, last + 2, 'assistant' FROM a""")
def j08_append(spark, sf_dir):
    """New exchanges of known and of new conversations: two messages each, numbered after the last one there, or from 0."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    asked = own.select("conv_id").distinct()
    new = asked.where("conv_id % 3 = 0").unionByName(asked.where("conv_id % 5 = 0").select((F.col("conv_id") + 100_000).alias("conv_id")))
    return state.append(own, new, "conv_id", "turn", "role", ("user", "assistant"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' THEN 'offer:' || substring(p_type, 7) ELSE p_type END AS kind FROM part")
def j11_prefix_rewrite(spark, sf_dir):
    kind = F.when(F.col("p_type").startswith("PROMO"), F.concat(F.lit("offer:"), F.expr("substring(p_type, 7)"))).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))


@query("SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN toxic = 1 THEN 'not_pending' WHEN d.lang IS NULL THEN 'no_reviewer' ELSE 'applied' END AS outcome FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id")
def j19_review(spark, sf_dir):
    """What becomes of each review."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(True).alias("there"))
    outcome = T.first_reason((F.col("there").isNull(), "missing"), (F.col("toxic") == 1, "not_pending"), (F.col("lang").isNull(), "no_reviewer"), (F.lit(True), "applied"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id", "left").select("doc_id", outcome.alias("outcome"))


@query("SELECT doc_id, lang AS before, guess AS after FROM (SELECT doc_id, lang, CASE WHEN contains(lower(text), ' the ') THEN 'en' WHEN contains(lower(text), ' und ') THEN 'de' WHEN contains(lower(text), ' les ') THEN 'fr' ELSE lang END AS guess FROM documents) WHERE lang <> guess")
def j20_relabel(spark, sf_dir):
    """Rows whose label a rule changes."""
    low = F.lower("text")
    guess = F.when(low.contains(" the "), "en").when(low.contains(" und "), "de").when(low.contains(" les "), "fr").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("before"), guess.alias("after")).where("before <> after")


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, coalesce(nullif(regexp_extract(url, '/([a-z]{2})/', 1), ''), 'none') AS section, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def k06_page_metadata(spark, sf_dir):
    section = F.regexp_extract("url", "/([a-z]{2})/", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.when(section != "", section).otherwise("none").alias("section"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(r"SELECT doc_id, lower(regexp_replace(text, '\s+', '', 'g')) AS key FROM documents")
def k11_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.key("text").alias("key"))


@query("SELECT conv_id, turn, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM conversations")
def k20_escape(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.escaped("text").alias("escaped"))


@query("SELECT event_id, sha256('{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}') AS digest FROM events")
def k24_canonical_hash(spark, sf_dir):
    """The digest of a record with sorted keys and no spaces."""
    return table(spark, sf_dir, "events").select("event_id", F.sha2(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))), 256).alias("digest"))


@query("SELECT event_id, TRY_CAST(json_extract_string(TRY_CAST(props AS JSON), '$.k') AS BIGINT) AS k FROM events")
def k26_lenient_json(spark, sf_dir):
    """Fences and text around the outermost braces are ignored; what is no JSON gives null."""
    noisy = F.concat(F.lit("answer: ```json\n"), F.col("props"), F.lit("\n``` done"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(T.json_part(noisy), "$.k").try_cast("long").alias("k"))


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS family, CASE split_part(o_orderpriority, '-', 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' ELSE 'rest' END AS kind FROM orders")
def k37_family(spark, sf_dir):
    family = F.split_part("o_orderpriority", F.lit("-"), F.lit(1))
    return table(spark, sf_dir, "orders").select("o_orderkey", family.alias("family"), F.when(family == "1", "urgent").when(family == "2", "high").otherwise("rest").alias("kind"))


@query("SELECT n_name, round(avg(x.effect), 6) AS effect, count(*) AS cases FROM (SELECT o_custkey, avg(CASE WHEN o_totalprice > 150000 THEN 1 WHEN o_totalprice < 50000 THEN -1 ELSE 0 END) AS effect FROM orders GROUP BY 1) x JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def l04_cluster_rollup(spark, sf_dir):
    """Cases to clusters: the mean of the cases' effects, each case once."""
    effect = F.when(F.col("o_totalprice") > 150000, 1).when(F.col("o_totalprice") < 50000, -1).otherwise(0)
    cases = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg(effect).alias("effect"))
    clusters = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return cases.join(clusters, "c_custkey").groupBy("n_name").agg(F.round(F.avg("effect"), 6).alias("effect"), F.count("*").alias("cases"))


@query("SELECT l_shipdate::DATE::VARCHAR AS day, CASE WHEN avg(l_discount) > 0.06 THEN 'regressed' WHEN avg(l_tax) > 0.05 THEN 'mixed' ELSE 'improved' END AS verdict FROM lineitem GROUP BY 1")
def l06_verdict(spark, sf_dir):
    verdict = F.when(F.avg("l_discount") > 0.06, "regressed").when(F.avg("l_tax") > 0.05, "mixed").otherwise("improved")
    return table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(verdict.alias("verdict"))


@query("SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS lines FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'O' GROUP BY 1")
def l07_one_sided(spark, sf_dir):
    """The lines that fail one test and pass the other, by order."""
    own = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_linestatus <> 'O'")
    return own.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")), ",").alias("lines"))


@query("SELECT source, count(DISTINCT text) AS texts, count(*) AS n, round(count(DISTINCT text) / count(*), 6) AS diversity FROM documents GROUP BY 1")
def l12_diversity(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("h"))
    return own.groupBy("source").agg(F.countDistinct("h").alias("texts"), F.count("*").alias("n"), F.round(F.countDistinct("h") / F.count("*"), 6).alias("diversity"))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, k, us AS opened, 1 AS n, 1 AS allowed, 1 AS windows FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.k, CASE WHEN e.us >= r.opened + 3600000000 THEN e.us ELSE r.opened END, CASE WHEN e.us >= r.opened + 3600000000 THEN 1 ELSE r.n + 1 END, r.allowed + CASE WHEN e.us >= r.opened + 3600000000 OR r.n < 10 THEN 1 ELSE 0 END, r.windows + CASE WHEN e.us >= r.opened + 3600000000 THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, max(allowed)::BIGINT AS allowed, (max(k) - max(allowed))::BIGINT AS refused, max(windows)::BIGINT AS windows FROM r GROUP BY 1""")
def m09_rate_limit(spark, sf_dir):
    """Ten events in each hour; an event after a window's end opens the next one."""
    own = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return state.rate_limit(own, "user_id", "us", 3_600_000_000, 10)


@query("SELECT user_id, max(event_id) + 1 AS next_id, 'failed' AS status FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'purchase'")
def m07_recovery(spark, sf_dir):
    """Keys whose last event is not terminal fail with the next number."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("last"), F.max_by("event_type", "event_id").alias("kind"))
    return last.where("kind <> 'purchase'").select("user_id", (F.col("last") + 1).alias("next_id"), F.lit("failed").alias("status"))


@query("SELECT 'ids_unique' AS gate, (SELECT count(*) = count(DISTINCT doc_id) FROM documents) AS passed UNION ALL SELECT 'labels_known', (SELECT count(*) = 0 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) UNION ALL SELECT 'turns_dense', (SELECT bool_and(m + 1 = n) FROM (SELECT max(turn) AS m, count(*) AS n FROM conversations GROUP BY conv_id))")
def p10_gates(spark, sf_dir):
    """Named checks with their outcome, one row each."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    unique = docs.agg((F.count("*") == F.countDistinct("doc_id")).alias("passed"))
    known = labels.join(docs, "doc_id", "left_anti").agg((F.count("*") == 0).alias("passed"))
    dense = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") + 1 == F.count("*")).alias("ok")).agg(F.every("ok").alias("passed"))
    named = lambda df, n: df.select(F.lit(n).alias("gate"), "passed")
    return named(unique, "ids_unique").unionByName(named(known, "labels_known")).unionByName(named(dense, "turns_dense"))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type))[1:3], ',') AS first_types FROM events GROUP BY 1")
def p05_top_rendering(spark, sf_dir):
    """At most three sorted entries a key."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("event_type")), 1, 3), ",").alias("first_types"))


@query("""WITH s AS (SELECT doc_id, unnest(range(0, length(text), 500)) AS start, text FROM documents WHERE doc_id % 3 = 0), t AS (SELECT doc_id, start, CASE WHEN doc_id % 29 = 0 THEN substring(text, start + 2, 500) ELSE substring(text, start + 1, 500) END AS said FROM s), d AS (SELECT * FROM documents WHERE doc_id % 23 <> 0)
SELECT t.doc_id, t.start, CASE WHEN d.doc_id IS NULL THEN 'missing' ELSE 'changed' END AS reason FROM t LEFT JOIN d USING (doc_id) WHERE d.doc_id IS NULL OR said <> substring(d.text, t.start + 1, 500)""")
def l09_replay_audit(spark, sf_dir):
    """Stored spans against their sources, some spans shifted and some sources gone: what differs, and why."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    start = F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(500)))
    spans = docs.where("doc_id % 3 = 0 and length(text) > 0").select("doc_id", "text", start.alias("start"))
    shift = F.when(F.col("doc_id") % 29 == 0, 2).otherwise(1)
    stored = spans.select("doc_id", "start", F.substring("text", F.col("start") + shift, F.lit(500)).alias("said"), F.lit(500).alias("size"))
    return curation.replay_audit(stored, docs.where("doc_id % 23 <> 0")).withColumn("start", F.col("start").cast("long"))

_DAMAGED = "CASE WHEN event_id % 7 = 0 THEN substring(props, 1, length(props) - 1) WHEN event_id % 11 = 0 THEN replace(replace(props, ': ', ': \"'), '}', '\"}') WHEN event_id % 13 = 0 THEN replace(props, '\"k\"', '\"key\"') WHEN event_id % 17 = 0 THEN '{\"k\": null}' WHEN event_id % 19 = 0 THEN NULL ELSE props END"


@query(f"""WITH d AS (SELECT event_id, {_DAMAGED} AS p FROM events), t AS (SELECT event_id, p, CASE WHEN json_valid(p) THEN json_type(p, '$.k') END AS kind FROM d)
SELECT event_id, CASE WHEN kind IN ('UBIGINT', 'BIGINT') THEN (p->>'$.k')::BIGINT END AS k,
 CASE WHEN p IS NULL THEN 'props:missing' WHEN NOT json_valid(p) THEN 'props:malformed' WHEN kind IS NULL THEN 'k:missing' WHEN kind = 'NULL' THEN 'k:null' WHEN kind NOT IN ('UBIGINT', 'BIGINT') THEN 'k:kind' ELSE '' END AS reasons FROM t""")
def a18_typed_props(spark, sf_dir):
    """The properties of events as typed columns, some of their texts damaged on the way, with the reason of each null."""
    own = table(spark, sf_dir, "events").select("event_id", F.expr(_DAMAGED).alias("props"))
    found = decode.decoded(own, "props", {"k": ("$.k", "long")})
    return found.select("event_id", "k", F.array_join("reasons", ",").alias("reasons"))


_KEYS = [
    export.ForeignKey("nation", "n_regionkey", "region", "r_regionkey"),
    export.ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"),
    export.ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey"),
    export.ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
    export.ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"),
    export.ForeignKey("lineitem", "l_partkey", "part", "p_partkey"),
    export.ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]


@query("""WITH r AS (SELECT * FROM region WHERE r_regionkey <> 1), n AS (SELECT * FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM r)), c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)),
s AS (SELECT * FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM n)), p AS (SELECT * FROM part), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) AND l_partkey IN (SELECT p_partkey FROM p) AND l_suppkey IN (SELECT s_suppkey FROM s))
SELECT 'region' AS "table", count(*) AS "rows" FROM r UNION ALL SELECT 'nation', count(*) FROM n UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'supplier', count(*) FROM s
UNION ALL SELECT 'part', count(*) FROM p UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l UNION ALL SELECT 'events', 0""")
def a17_export(spark, sf_dir):
    """All tables of the star schema without one region and whatever hangs on it, the events without rows, as one revision: what each table kept."""
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
    own = export.Exports(spark, f"{tables.shared_dir(spark)}/millrace/export-{uuid.uuid4().hex}")
    own.export({n: table(spark, sf_dir, n) for n in names}, _KEYS, {"region": "r_regionkey <> 1"}, ("events",))
    return own.manifest().select("table", "rows")


@query("""WITH k AS (SELECT source, text FROM documents WHERE source IS DISTINCT FROM 'src0' AND source IS NOT NULL AND text IS NOT NULL),
o AS (SELECT source AS owner, count(*) AS artifacts, count(DISTINCT text) AS contents, sum(octet_length(encode(text)))::BIGINT AS bytes FROM k GROUP BY 1)
SELECT * FROM o UNION ALL SELECT '', (SELECT count(*) FROM k), (SELECT count(DISTINCT text) FROM k), (SELECT sum(octet_length(encode(text)))::BIGINT FROM (SELECT DISTINCT text FROM k))""")
def a19_store(spark, sf_dir):
    """Documents as artifacts of their sources, put in two batches; one source deletes all it has, and a sweep follows. For each owner, and in all, what is stored."""
    docs, own = table(spark, sf_dir, "documents"), store.Store(spark, f"{tables.shared_dir(spark)}/millrace/store-{uuid.uuid4().hex}")
    rows = docs.select(F.col("source").alias("owner"), F.col("doc_id").alias("key"), F.col("text").alias("content"), "lang")
    own.put(rows.where("lang = 'en'"))
    own.put(rows.where("lang IS DISTINCT FROM 'en'"))
    own.delete(rows.where("owner = 'src0'"))
    own.sweep()
    each = own.names().groupBy("owner").agg(F.count("*").alias("artifacts"), F.countDistinct("digest").alias("contents"), F.sum("size").alias("bytes"))
    stored = own.contents().agg(F.count("*").alias("contents"), F.sum(F.octet_length("content").cast("long")).alias("bytes"))
    names = own.names().agg(F.count("*").alias("artifacts"))
    return each.unionByName(names.crossJoin(stored).select(F.lit("").alias("owner"), "artifacts", "contents", "bytes"))
