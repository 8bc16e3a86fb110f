"""Rules over records, spans and streams of work: settings, manifests, votes, evidence, budgets of readiness, score parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import derive, rules, sequence
from millrace.plans.catalog import query, table
from millrace.plans.retrieval import BM25, ranked
from millrace.streaming import jobs


@query("SELECT n AS doc_id, coalesce(substring(text, 1, 40), '') AS head FROM (VALUES (1), (7), (99999999)) v(n) LEFT JOIN documents ON doc_id = n")
def a02_point_lookup(spark, sf_dir):
    """A few ids looked up, with an empty text for those that are not there."""
    wanted = spark.createDataFrame([(1,), (7,), (99999999,)], "doc_id int")
    docs = table(spark, sf_dir, "documents").where(F.col("doc_id").isin(1, 7, 99999999)).select("doc_id", F.substring("text", 1, 40).alias("head"))
    return wanted.join(docs, "doc_id", "left").select("doc_id", F.coalesce("head", F.lit("")).alias("head"))


@query("WITH p AS (SELECT label AS collection, max(vec_id % 3) AS generation FROM embeddings GROUP BY 1) SELECT collection, generation, count(*) AS items FROM embeddings JOIN p ON label = collection AND vec_id % 3 = generation GROUP BY ALL")
def c02_active_generation(spark, sf_dir):
    """What each collection's pointer names: rows joined by collection and generation."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("collection"), (F.col("vec_id") % 3).alias("generation"))
    pointer = rows.groupBy("collection").agg(F.max("generation").alias("generation"))
    return rows.join(pointer, ["collection", "generation"]).groupBy("collection", "generation").agg(F.count("*").alias("items"))


@query(f"""{BM25}, n AS (SELECT query_id, doc_id, rank FROM bm WHERE rank <= 10), a AS (SELECT query_id, unnest(list(doc_id ORDER BY doc_id)) AS doc_id, generate_subscripts(list(doc_id ORDER BY doc_id), 1) AS pos, count(*) AS size FROM n WHERE rank % 2 = 1 GROUP BY 1)
SELECT a.query_id::BIGINT AS query_id, a.doc_id, (size - pos + 1)::BIGINT AS score FROM a JOIN n USING (query_id, doc_id)""")
def e09_list_rerank(spark, sf_dir):
    """A list of names in an order of its own: those that are candidates stay, each scored by its distance to the list's end."""
    found = ranked(spark, sf_dir, 10).select("query_id", "doc_id", "rank")
    named = found.where("rank % 2 = 1").groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("names"))
    each = named.select("query_id", F.size("names").alias("size"), F.posexplode("names").alias("pos", "doc_id"))
    return each.join(found, ["query_id", "doc_id"]).select("query_id", "doc_id", (F.col("size") - F.col("pos")).cast("long").alias("score"))


@query(f"""{BM25}, e AS (SELECT query_id, rank, doc_id, source FROM bm JOIN documents USING (doc_id) WHERE rank <= 24 AND length(trim(text)) > 0 AND source IS NOT NULL),
f AS (SELECT query_id, source, min(rank) AS first FROM e GROUP BY ALL) SELECT query_id::BIGINT AS query_id, count(*) AS evidence, (SELECT string_agg(source, ',' ORDER BY first) FROM f WHERE f.query_id = e.query_id) AS anchors FROM e GROUP BY query_id""")
def e10_evidence(spark, sf_dir):
    """Hits joined to their texts, empty ones dropped; the sources they anchor to, each once, in the order of the best hit."""
    best = ranked(spark, sf_dir, 24).select("query_id", "doc_id", "rank")
    docs = table(spark, sf_dir, "documents").where((F.length(F.trim("text")) > 0) & F.col("source").isNotNull()).select("doc_id", "source")
    per = docs.join(best, "doc_id").groupBy("query_id", "source").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    order = F.array_sort(F.collect_list(F.struct("first", "source")))  # at most 24 a query
    return per.groupBy("query_id").agg(F.sum("n").alias("evidence"), F.array_join(F.transform(order, lambda x: x["source"]), ",").alias("anchors"))


_STYLE = """WITH l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY 1), s AS (SELECT doc_id, least(1, n_chars / 5000.0::DOUBLE) AS dense, coalesce(q, 0)::DOUBLE AS quality, (doc_id % 10) / 10.0::DOUBLE AS auth, lang = 'en' AS scene,
 doc_id % 2 = 0 AS mode, n_chars <= 400 AS len, source IS NULL AS syn, doc_id % 5 = 0 AS recent, coalesce(x, 0) = 1 AS strong FROM documents LEFT JOIN l USING (doc_id)),
p AS (SELECT doc_id, 0.55 * dense AS a, 0.2 * quality AS b, 0.15 * auth AS c, CASE WHEN scene THEN 0.12 ELSE 0 END AS d, CASE WHEN mode THEN 0.08 ELSE 0 END AS e, CASE WHEN len THEN 0.05 ELSE 0 END AS f,
 least(0.18, 0.12 * (1.0 + CASE WHEN scene THEN 0.25 ELSE 0 END)) AS g, CASE WHEN strong THEN 0.35 ELSE 0 END AS h, CASE WHEN syn THEN -0.12 ELSE 0 END AS i, CASE WHEN recent THEN -0.4 ELSE 0 END AS j, -least(0.64, 0.32 * 0.5 + CASE WHEN strong THEN 0.32 * 0.9 ELSE 0 END) AS k FROM s)
"""


@query(_STYLE + "SELECT doc_id, round((a + b + c + d + e + f + g + h + i + j + k)::DOUBLE, 6) AS score, round(g::DOUBLE, 6) AS behaviour, round(k::DOUBLE, 6) AS expression FROM p")
def e13_style_score(spark, sf_dir):
    """All eleven parts of a style score over stand-in columns of documents and labels."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("x"))
    own = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")
    english, strong = F.coalesce(F.col("lang") == "en", F.lit(False)), F.coalesce(F.col("x"), F.lit(0)) == 1
    words = lambda c, one, two: F.when(c, F.array(F.lit(one), F.lit(two))).otherwise(F.array(F.lit(one)))
    rows = own.select(
        "doc_id",
        F.least(F.lit(1.0), F.col("n_chars") / 5000).alias("dense"),
        F.coalesce("q", F.lit(0)).cast("double").alias("quality"),
        ((F.col("doc_id") % 10) / 10).alias("authenticity"),
        english.alias("scene"),
        (F.col("doc_id") % 2 == 0).alias("mode"),
        (F.col("n_chars") <= 400).alias("length"),
        F.col("source").isNull().alias("synthetic"),
        (F.col("doc_id") % 5 == 0).alias("recent"),
        words(english, "warm", "brief").alias("behaviours"),
        words(strong, "mild", "strong").alias("expressions"),
        F.lit(0.8).alias("penalty"),
        F.create_map(F.lit("mild"), F.lit(0.5), F.lit("strong"), F.lit(0.9)).alias("rates"),
    )
    weights = F.create_map(F.lit("warm"), F.lit(1.0), F.lit("brief"), F.lit(0.25), F.lit("release"), F.lit(0.5))
    parts = rules.style_parts(weights)
    total = sum(parts.values(), F.lit(0.0))
    return rows.select("doc_id", F.round(total, 6).alias("score"), F.round(parts["behaviour"], 6).alias("behaviour"), F.round(parts["expression"], 6).alias("expression"))


@query("""WITH RECURSIVE e AS (SELECT user_id, value / 500 AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
m AS (SELECT a.user_id, a.k, a.n, CASE WHEN a.n >= 3 THEN list_sort([p.x, a.x, q.x])[2] ELSE a.x END AS m FROM e a JOIN e p ON p.user_id = a.user_id AND p.k = (a.k + a.n - 2) % a.n + 1 JOIN e q ON q.user_id = a.user_id AND q.k = a.k % a.n + 1),
f AS (SELECT a.user_id, a.k, a.n, CASE WHEN a.n >= 3 AND a.k = 1 THEN greatest(a.m, 0.35::DOUBLE * b.m) ELSE a.m END AS m FROM m a LEFT JOIN m b ON b.user_id = a.user_id AND b.k = a.k + 1),
g AS (SELECT a.user_id, a.k, a.n, CASE WHEN a.n >= 3 AND a.k = a.n THEN least(a.m, b.m) ELSE a.m END AS m FROM f a LEFT JOIN f b ON b.user_id = a.user_id AND b.k = a.k - 1),
t AS (SELECT user_id, k, greatest(m, 0.42::DOUBLE * coalesce(lead(m) OVER (PARTITION BY user_id ORDER BY k), 0)) AS t FROM g),
r AS (SELECT user_id, 0::BIGINT AS k, 0.0::DOUBLE AS v FROM (SELECT DISTINCT user_id FROM e) UNION ALL SELECT t.user_id, t.k, CASE WHEN t.t = 0 AND r.v + (CASE WHEN t.t > r.v THEN 0.72::DOUBLE ELSE 0.48::DOUBLE END) * (t.t - r.v) < 0.035 THEN 0 ELSE r.v + (CASE WHEN t.t > r.v THEN 0.72::DOUBLE ELSE 0.48::DOUBLE END) * (t.t - r.v) END FROM r JOIN t ON t.user_id = r.user_id AND t.k = r.k + 1)
SELECT r.user_id, event_id, round(v, 6) AS envelope FROM r JOIN (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) i ON i.user_id = r.user_id AND i.k = r.k""")
def k35_attack_release(spark, sf_dir):
    """Values of a user's events as levels, smoothed with a fast rise and a slow fall."""
    own = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 500).alias("level"))
    return sequence.envelope(own, "user_id", "event_id", "level")


@query("SELECT o_custkey AS parent, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders")
def g05_versions(spark, sf_dir):
    """All versions of each parent, oldest first."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("id"), F.row_number().over(w).cast("long").alias("version"))


@query("""WITH x AS (SELECT DISTINCT l_suppkey AS key, (l_quantity * 10)::BIGINT AS s, (l_quantity * 10 + l_linenumber * 7)::BIGINT AS e FROM lineitem), m AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x)
SELECT key, s AS start, e AS "end" FROM m WHERE reach IS NULL OR e > reach QUALIFY row_number() OVER (PARTITION BY key ORDER BY s, e DESC) <= 8""")
def g07_outer_spans(spark, sf_dir):
    """Spans by start, longest first, without those inside another, eight a key."""
    start = (F.col("l_quantity") * 10).cast("long")
    own = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), start.alias("start"), (start + F.col("l_linenumber") * 7).cast("long").alias("end"))
    return sequence.outer_spans(own, "key", "start", "end", 8)


@query(r"WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}]{2,}') AS t FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ' ') AS words FROM t")
def i01_first_occurrences(spark, sf_dir):
    """A turn's words, each at its first place."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_distinct(T.tokens("text")), " ").alias("words"))


@query("SELECT conv_id, turn, unnest(p)::BIGINT AS position FROM (SELECT conv_id, turn, list_transform(range(1, len(s)), lambda i: list_sum(list_transform(s[1:i], lambda x: length(x))) + (i - 1) * 2) AS p FROM (SELECT conv_id, turn, string_split(text, 'en') AS s FROM conversations))")
def k04_positions(spark, sf_dir):
    """Every place of a string in a turn."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(rules.positions("text", "en")).alias("position")).withColumn("position", F.col("position").cast("long"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def k05_iso_date(spark, sf_dir):
    """Dates read out of sentences that hold them with year, month and day signs."""
    day = F.col("o_orderdate").cast("timestamp")
    said = F.concat(F.lit("更新于"), F.year(day), F.lit("年"), F.month(day), F.lit("月"), F.dayofmonth(day), F.lit("日。"))
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.iso_date(said).alias("iso"))


_KEEP = r"https?://\S+|[0-9]+[.,:][0-9]+"


@query(rf"""WITH s AS (SELECT conv_id, turn, regexp_extract_all(trim(text), '(?s){_KEEP}|.') AS s FROM conversations), c AS (SELECT conv_id, turn, array_to_string(list_transform(s, lambda x: CASE WHEN x IN (',', '.', ';', '!') THEN ' ' ELSE x END), '') AS t, len(list_filter(s, lambda x: x IN (',', '.', ';', '!')))::BIGINT AS replaced FROM s)
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')) AS text, replaced FROM c""")
def k13_normalised(spark, sf_dir):
    """Marks become spaces outside links and numbers, and white space is tidied."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rules.normalised("text", ",.;!", _KEEP).alias("n")).select("conv_id", "turn", "n.text", "n.replaced")


@query("""WITH o AS (SELECT user_id AS p, min(event_id) AS id, arg_min(value, event_id) AS v, count(*) AS n FROM events WHERE event_type = 'error' AND value > 400 GROUP BY 1), s AS (SELECT c_custkey AS p, c_acctbal AS d FROM customer WHERE c_custkey <= 100)
SELECT coalesce(s.p, o.p) AS name, CASE WHEN n = 1 AND d IS NOT NULL AND v <= 480 THEN v ELSE d END AS value, CASE WHEN n = 1 AND d IS NOT NULL AND v <= 480 THEN id END AS source, CASE WHEN n IS NULL THEN '' WHEN d IS NULL THEN 'unknown' WHEN n > 1 THEN 'conflict' WHEN v > 480 THEN 'above' ELSE 'override' END AS reason FROM s FULL JOIN o ON s.p = o.p""")
def k38_settings(spark, sf_dir):
    """Defaults and overrides: one active override a parameter, within its range."""
    specs = table(spark, sf_dir, "customer").where("c_custkey <= 100").select(F.col("c_custkey").alias("name"), F.col("c_acctbal").alias("default"), F.lit(0.0).alias("low"), F.lit(480.0).alias("high"))
    given = table(spark, sf_dir, "events").where("event_type = 'error' and value > 400").select(F.col("event_id").alias("override_id"), F.col("user_id").alias("name"), "value")
    return rules.settings(specs, given)


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN 'tie' WHEN 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'base' ELSE 'new' END ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'new' ELSE 'base' END END AS winner FROM lineitem")
def l01_winner(spark, sf_dir):
    """Which variant a judgment prefers, whichever side it stood on."""
    swapped = F.col("l_linenumber") % 2 == 0
    left, right = F.when(swapped, "base").otherwise("new"), F.when(swapped, "new").otherwise("base")
    winner = F.when(F.col("l_returnflag") == "N", "tie").when(F.col("l_returnflag") == "A", left).otherwise(right)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", winner.alias("winner"))


@query("""SELECT 'turns' AS measure, count(*)::DOUBLE AS value FROM conversations WHERE role = 'assistant' UNION ALL SELECT 'question_rate', round(avg(contains(text, '?')::INT), 6) FROM conversations WHERE role = 'assistant' UNION ALL SELECT 'long_turns', sum((length(text) > 300)::INT)::DOUBLE FROM conversations WHERE role = 'assistant'
UNION ALL SELECT 'action:' || r, count(*)::DOUBLE FROM (SELECT unnest([CASE WHEN contains(text, ',') THEN 'comma' END, CASE WHEN length(text) > 300 THEN 'long' END, CASE WHEN contains(text, '!') THEN 'stress' END]) AS r FROM conversations WHERE role = 'assistant') WHERE r IS NOT NULL GROUP BY r""")
def l10_frequency_report(spark, sf_dir):
    """A report over multi-turn runs: totals, rates and the counts of each action, a row a measure."""
    own = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("text")
    totals = own.agg(F.count("*").cast("double").alias("turns"), F.round(F.avg(F.col("text").contains("?").cast("int")), 6).alias("question_rate"), F.sum((F.length("text") > 300).cast("double")).alias("long_turns"))
    flat = totals.select(F.explode(F.create_map(*[x for c in totals.columns for x in (F.lit(c), F.col(c))])).alias("measure", "value"))
    reasons = T.all_reasons((F.col("text").contains(","), "comma"), (F.length("text") > 300, "long"), (F.col("text").contains("!"), "stress"))
    actions = own.select(F.explode(reasons).alias("r")).groupBy("r").agg(F.count("*").cast("double").alias("value"))
    return flat.unionByName(actions.select(F.concat(F.lit("action:"), "r").alias("measure"), "value"))


@query("""WITH g AS (SELECT l_orderkey AS case_id, l_linenumber, CASE WHEN l_discount >= 0.09 THEN 'cheap' WHEN l_quantity > 45 THEN 'bulk' WHEN l_tax > 0.07 THEN 'taxed' END AS reason FROM lineitem WHERE l_linestatus = 'F')
SELECT reason, count(*) AS removed, count(DISTINCT case_id) AS affected FROM g WHERE reason IS NOT NULL GROUP BY 1""")
def l11_guard_replay(spark, sf_dir):
    """A guard replayed over the examples of measured cases: what each reason removes, and how many cases it touches."""
    rule = T.first_reason((F.col("l_discount") >= 0.09, "cheap"), (F.col("l_quantity") > 45, "bulk"), (F.col("l_tax") > 0.07, "taxed"))
    own = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select("l_orderkey", rule.alias("reason")).where("reason is not null")
    return own.groupBy("reason").agg(F.count("*").alias("removed"), F.countDistinct("l_orderkey").alias("affected"))


@query("SELECT event_type, max(value) AS peak, min(value) AS least, arg_max(event_id, {'v': value, 'e': -event_id}) AS peak_at FROM events GROUP BY 1")
def l13_peaks(spark, sf_dir):
    own = table(spark, sf_dir, "events")
    return own.groupBy("event_type").agg(F.max("value").alias("peak"), F.min("value").alias("least"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("peak_at"))


@query("SELECT v.vec_id, coalesce(n.label, v.label) AS label, CASE WHEN n.vec_id IS NULL THEN 1 ELSE 2 END::BIGINT AS revision FROM embeddings v LEFT JOIN (SELECT vec_id, label + 100 AS label FROM embeddings WHERE vec_id % 7 = 0) n USING (vec_id) UNION ALL SELECT vec_id + 1000000, label, 2::BIGINT FROM embeddings WHERE vec_id % 50 = 0")
def j14_vector_upsert(spark, sf_dir):
    """A new generation of vectors: the old ones, those that a batch replaces, and those that it adds; lengths must agree."""
    own = table(spark, sf_dir, "embeddings")
    batch = own.where("vec_id % 7 = 0").withColumn("label", F.col("label") + 100).unionByName(own.where("vec_id % 50 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000))
    width = own.agg(F.max(F.size("embedding"))).head()[0]
    checked = batch.withColumn("embedding", F.when(F.assert_true(F.size("embedding") == width, F.lit("vectors of different lengths")).isNull(), F.col("embedding")))
    kept = own.join(batch.select("vec_id"), "vec_id", "left_anti")
    out = kept.withColumn("revision", F.lit(1).cast("long")).unionByName(checked.withColumn("revision", F.lit(2).cast("long")))
    return out.select("vec_id", F.col("label"), "revision")


@query("SELECT c.user_id, c.event_id, 'failed' AS status FROM events c WHERE event_type = 'click' AND value > 100 AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = c.user_id AND p.ts::DATE = c.ts::DATE AND p.event_type = 'purchase' AND p.event_id > c.event_id)")
def j10_recovery_insert(spark, sf_dir):
    """Requests that nothing later on their day settles get a row that says they failed."""
    own = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    settled = own.where("event_type = 'purchase'").groupBy("user_id", "day").agg(F.max("event_id").alias("last"))
    asked = own.where("event_type = 'click' and value > 100").select("user_id", "day", "event_id")
    left = asked.join(settled, ["user_id", "day"], "left").where("last is null or last <= event_id")
    return left.select("user_id", "event_id", F.lit("failed").alias("status"))


@query("WITH v AS (SELECT user_id AS chat_id, event_id % 40 AS message_id, value > 250 AS up, event_id AS t, event_type = 'purchase' AS fresh FROM events WHERE event_type IN ('purchase', 'click')) SELECT chat_id, message_id, arg_max(up, {'f': fresh::INT, 'a': t}) AS up, arg_max(t, {'f': fresh::INT, 'a': t}) AS \"at\" FROM v GROUP BY ALL")
def j18_vote(spark, sf_dir):
    """Clicks as the votes that stand, purchases as new ones: a message in a chat has one vote."""
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("chat_id"), (F.col("event_id") % 40).alias("message_id"), (F.col("value") > 250).alias("up"), F.col("event_id").alias("at"), "event_type")
    return rules.vote(own.where("event_type = 'click'").drop("event_type"), own.where("event_type = 'purchase'").drop("event_type"))


@query("""WITH w AS (SELECT user_id, event_id, event_type = 'click' AS made, greatest(0, coalesce(sum((event_type = 'click')::INT - (event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS ahead FROM events)
SELECT user_id, event_id, ahead, made AND ahead >= 2 AS waits FROM w""")
def m05_back_pressure(spark, sf_dir):
    """Clicks as segments made and purchases as segments consumed: a segment waits while two are ready."""
    own = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return rules.ready_ahead(own, "user_id", "event_id", F.col("event_type") == "click", F.col("event_type") == "purchase").drop("event_type")


@query("SELECT event_id, user_id, floor(value / 100)::BIGINT AS grade FROM events WHERE event_type = 'purchase'")
def m12_commit_marker(spark, sf_dir):
    """Each turn's effect once, though every turn is delivered twice and the batches are replayed: effects are written with a marker, and marked turns are passed over."""
    own = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id", "value", "ts")
    return jobs.committed(spark, own.unionByName(own), "event_id", lambda d: d.select("event_id", "user_id", F.floor(F.col("value") / 100).cast("long").alias("grade")))


@query("""WITH m AS (SELECT doc_id AS name, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 0 AND text IS NOT NULL), f AS (SELECT doc_id AS name, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 17 <> 0 AND text IS NOT NULL)
SELECT coalesce(m.name, f.name) AS name, CASE WHEN f.h IS NULL THEN 'missing' WHEN m.h IS NULL THEN 'unlisted' ELSE 'changed' END AS reason FROM m FULL JOIN f ON m.name = f.name WHERE m.h IS DISTINCT FROM f.h""")
def p01_manifest(spark, sf_dir):
    """A manifest against the files it lists, some of them changed, missing or not listed."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    listed = docs.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("name"), F.sha2("text", 256).alias("sha256"))
    changed = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    files = docs.where("doc_id % 17 <> 0").select(F.col("doc_id").alias("name"), F.sha2(changed, 256).alias("sha256"))
    return rules.manifest_check(listed, files)


@query("SELECT vec_id, label, 'g2' AS generation, CASE WHEN label = 3 THEN 'kept,three' ELSE 'kept' END AS tags FROM embeddings")
def p09_clone_generation(spark, sf_dir):
    """The rows of a generation under a new name; tags join as an ordered set."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.array(F.lit("kept")).alias("tags"))
    new = F.when(F.col("label") == 3, F.array(F.lit("three"), F.lit("kept"))).otherwise(F.array(F.lit("kept")))
    return own.select("vec_id", "label", F.lit("g2").alias("generation"), F.array_join(F.array_union("tags", new), ",").alias("tags"))


@query("SELECT event_type, n AS sample, least(total, floor(n * 480 / 20.0))::BIGINT AS at FROM (SELECT event_type, unnest(range(0, (ceil(count(*) * 20 / 480.0))::BIGINT + 1)) AS n, count(*) AS total FROM events GROUP BY 1)")
def p07_frames(spark, sf_dir):
    """The first sample of each frame of 20 a second at 480 samples a second, to the end."""
    per = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("total"))
    frames = per.select("event_type", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("total") * 20 / 480.0).cast("long"))).alias("sample"))
    return frames.select("event_type", "sample", F.least("total", F.floor(F.col("sample") * 480 / 20.0).cast("long")).alias("at"))


_FACTS = ("lang", "source", "n_chars", "quality", "toxic")
_RULES = [(1, 0, "size", "long"), (2, 0, "size", "short"), (3, 10, "tier", "gold"), (4, 20, "tier", "reject"), (5, 30, "tier", "reject"), (6, 1, "use", "train"), (7, 5, "use", "drop"), (8, 1, "use", "drop"), (9, 0, "audience", "anyone")]
_CONDITIONS = [(1, "n_chars", ">=", "2000"), (2, "n_chars", "<", "50"), (3, "quality", "=", "1"), (3, "size", "=", "long"), (4, "quality", "=", "0"), (5, "toxic", "=", "1"), (6, "tier", "=", "gold"), (6, "lang", "<>", "es"), (7, "tier", "=", "reject"), (8, "size", "=", "short")]


@query("""WITH l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY 1), d AS (SELECT DISTINCT doc_id, lang, n_chars, q, x FROM documents LEFT JOIN l USING (doc_id)),
f AS (
  SELECT doc_id, 'size' AS attribute, 'long' AS value, 1 AS rule_id, 1 AS round, 0 AS priority FROM d WHERE n_chars >= 2000
  UNION ALL SELECT doc_id, 'size', 'short', 2, 1, 0 FROM d WHERE n_chars < 50
  UNION ALL SELECT doc_id, 'tier', 'gold', 3, 2, 10 FROM d WHERE q = 1 AND n_chars >= 2000
  UNION ALL SELECT doc_id, 'tier', 'reject', 4, 1, 20 FROM d WHERE q = 0
  UNION ALL SELECT doc_id, 'tier', 'reject', 5, 1, 30 FROM d WHERE x = 1
  UNION ALL SELECT doc_id, 'use', 'train', 6, 3, 1 FROM d WHERE q = 1 AND n_chars >= 2000 AND lang <> 'es'
  UNION ALL SELECT doc_id, 'use', 'drop', 7, 2, 5 FROM d WHERE q = 0 OR x = 1
  UNION ALL SELECT doc_id, 'use', 'drop', 8, 2, 1 FROM d WHERE n_chars < 50
  UNION ALL SELECT doc_id, 'audience', 'anyone', 9, 1, 0 FROM d)
SELECT doc_id, attribute, value, rule_id::BIGINT AS rule_id, round::INTEGER AS round, row_number() OVER (PARTITION BY doc_id, attribute ORDER BY priority DESC, rule_id) = 1 AS chosen, min(value) OVER (PARTITION BY doc_id, attribute) <> max(value) OVER (PARTITION BY doc_id, attribute) AS conflict FROM f""")
def k31_derived_policy(spark, sf_dir):
    """What nine rules derive for each document from its columns and labels, in up to three rounds, with the rule that decides."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    own = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in _FACTS])).alias("x")
    facts = own.select(F.col("doc_id").alias("entity"), listed).select("entity", "x.attribute", "x.value")
    rules_ = spark.createDataFrame(_RULES, "rule_id long, priority int, attribute string, value string")
    conditions = spark.createDataFrame(_CONDITIONS, "rule_id long, attribute string, op string, value string")
    return derive.derive(facts, rules_, conditions).withColumnRenamed("entity", "doc_id")
