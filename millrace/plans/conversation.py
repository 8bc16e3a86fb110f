"""Conversations, ordered sequences, state as rewrites, text functions and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import chunks, extract, patterns, rank, segmentation, sequence, state
from millrace.plans.catalog import query, table


def _turns(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# Windows over turns and events.
@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1 AS current FROM events")
def f01_latest_revision(spark, sf_dir):
    return sequence.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("event_id", "current")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def f02_last_n_turns(spark, sf_dir):
    return sequence.last_n(_turns(spark, sf_dir), "conv_id", "turn", 3).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, last_value(CASE WHEN trim(text) <> '' THEN substring(text, 1, 240) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before, first_value(CASE WHEN trim(text) <> '' THEN substring(text, 1, 240) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS after FROM conversations")
def f04_neighbour_context(spark, sf_dir):
    return sequence.neighbours(_turns(spark, sf_dir), "conv_id", "turn", "text").select("conv_id", "turn", "before", "after")


@query("SELECT conv_id, turn, lead(role) OVER w AS next_role, lead(length(text)) OVER w AS next_size FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def f05_lead(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return _turns(spark, sf_dir).select("conv_id", "turn", F.lead("role").over(w).alias("next_role"), F.lead(F.length("text").cast("long")).over(w).alias("next_size"))


@query("WITH e AS (SELECT *, list(CASE WHEN contains(text, ',') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS x FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, round(list_sum(list_transform(list_reverse(x), lambda v, i: v * 0.7::DOUBLE ** (i - 1))) / list_sum(list_transform(x, lambda v, i: 0.7::DOUBLE ** (i - 1))), 6) AS rate FROM e")
def f06_decayed_rate(spark, sf_dir):
    """How often the last five replies hold a comma, newest first with factor 0.7."""
    own = _turns(spark, sf_dir).where("role = 'assistant'")
    return sequence.decayed_rate(own, "conv_id", "turn", F.when(F.col("text").contains(","), 1.0).otherwise(0.0), 5).select("conv_id", "turn", "rate")


@query("WITH s AS (SELECT *, CASE WHEN role = 'user' OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 1 ELSE 0 END AS o FROM conversations) SELECT conv_id, turn, (sum(o) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS island FROM s")
def f08_exchange_groups(spark, sf_dir):
    return _long(sequence.islands(_turns(spark, sf_dir), "conv_id", "turn", F.col("role") == "user"), "island").select("conv_id", "turn", "island")


@query("SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM conversations")
def f09_running_offset(spark, sf_dir):
    own = sequence.running_offset(_turns(spark, sf_dir), "conv_id", "turn", F.length("text") + 1)
    return _long(own, "offset").select("conv_id", "turn", "offset")


_SPANS = "SELECT l_orderkey AS key, (l_quantity * 10)::BIGINT AS s, (l_quantity * 10 + 40)::BIGINT AS e FROM lineitem"


def _spans(spark, sf_dir: str) -> DataFrame:
    start = (F.col("l_quantity") * 10).cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", start.alias("start"), (start + 40).alias("end"))


@query(f"WITH x AS (SELECT key, s, e, count(*) AS n FROM ({_SPANS}) GROUP BY ALL), m AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT key, min(s) AS start, max(e) AS \"end\", sum(n)::BIGINT AS n FROM g GROUP BY key, g")
def f10_interval_merge(spark, sf_dir):
    return sequence.merge_intervals(_spans(spark, sf_dir).select("key", "start", "end"), "key", "start", "end").select("key", "start", "end", "n")


@query("WITH r AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS total FROM conversations) SELECT conv_id, min(turn) AS first_turn, count(*) AS n FROM r WHERE total <= 1500 GROUP BY 1")
def f11_suffix_packing(spark, sf_dir):
    """The newest turns of a conversation that fit in 1,500 characters together."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    own = _turns(spark, sf_dir).select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("total"))
    return own.where("total <= 1500").groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"))


@query("""WITH RECURSIVE i AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
p AS (SELECT conv_id, turn, k, size <= 800 AS kept, CASE WHEN size <= 800 THEN size ELSE 0 END AS used FROM i WHERE k = 1
UNION ALL SELECT i.conv_id, i.turn, i.k, p.used + i.size <= 800, CASE WHEN p.used + i.size <= 800 THEN p.used + i.size ELSE p.used END FROM p JOIN i ON i.conv_id = p.conv_id AND i.k = p.k + 1)
SELECT conv_id, turn, kept FROM p""")
def f12_budget_pack(spark, sf_dir):
    """Turns in order within 800 characters; one that does not fit is passed over."""
    own = _turns(spark, sf_dir).select("conv_id", F.col("turn").alias("id"), F.col("turn").alias("place"), F.length("text").cast("long").alias("size"))
    return sequence.pack(own, "conv_id", 800, "place").select("conv_id", F.col("id").alias("turn"), "kept")


@query("SELECT conv_id, arg_max(role, turn) = 'user' AS pending FROM conversations GROUP BY 1")
def f13_pending_flag(spark, sf_dir):
    return _turns(spark, sf_dir).groupBy("conv_id").agg((F.max_by("role", "turn") == "user").alias("pending"))


@query("SELECT user_id, count(*) - max(CASE WHEN value > 400 THEN n ELSE 0 END) AS quiet FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) GROUP BY 1")
def f15_trailing_run(spark, sf_dir):
    """Events of a user since the last one above a level."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    own = table(spark, sf_dir, "events").select("user_id", "value", n.cast("long").alias("n"))
    return own.groupBy("user_id").agg((F.count("*") - F.max(F.when(F.col("value") > 400, F.col("n")).otherwise(0))).alias("quiet"))


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error' UNION ALL (SELECT event_id, event_type FROM events WHERE event_type <> 'error' ORDER BY sha256('7:' || event_id), event_id LIMIT 200)")
def f16_stratified_sample(spark, sf_dir):
    """All error events, and the 200 others with the smallest digests of seed and id: the same rows on every run."""
    own = table(spark, sf_dir, "events").select("event_id", "event_type")
    rest = own.where("event_type <> 'error'").orderBy(F.sha2(F.concat(F.lit("7:"), F.col("event_id").cast("string")), 256), "event_id").limit(200)
    return own.where("event_type = 'error'").unionByName(rest)


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM conversations")
def c20_prev_user_turn(spark, sf_dir):
    return sequence.previous_where(_turns(spark, sf_dir), "conv_id", "turn", F.col("role") == "user", "text", "asked").select("conv_id", "turn", "asked")


@query(f"WITH x AS (SELECT l_linenumber AS n, key, s, e FROM ({_SPANS.replace('FROM lineitem', ', l_linenumber FROM lineitem')})) SELECT a.key, a.n::BIGINT AS a, b.n::BIGINT AS b FROM x a JOIN x b ON a.key = b.key AND a.n < b.n AND a.s < b.e AND b.s < a.e")
def c13_span_overlap(spark, sf_dir):
    own = _spans(spark, sf_dir)
    found = sequence.overlaps(own, own, "key").where("l_linenumber < l_linenumber_r")
    return found.select("key", F.col("l_linenumber").cast("long").alias("a"), F.col("l_linenumber_r").cast("long").alias("b"))


@query("""WITH c AS (SELECT user_id, epoch_ms(ts) AS s, epoch_ms(ts) + 3600000 AS e, value FROM events WHERE event_type = 'purchase'), n AS (SELECT user_id, s, max(value) AS value, max(e) AS e FROM c GROUP BY ALL),
p AS (SELECT event_id, user_id, epoch_ms(ts) AS at FROM events WHERE event_type = 'click') SELECT event_id, CASE WHEN n.e > p.at THEN n.value ELSE 0 END AS value FROM p ASOF LEFT JOIN n ON p.user_id = n.user_id AND p.at >= n.s""")
def c14_point_in_interval(spark, sf_dir):
    """The value of the user's latest purchase within the hour before a click, else 0."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    own = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", ms.alias("at"))
    cues = own.where("event_type = 'purchase'").groupBy("user_id", F.col("at").alias("start")).agg(F.max("value").alias("value")).withColumn("end", F.col("start") + 3_600_000)
    points = own.where("event_type = 'click'").select("event_id", "user_id", "at")
    return sequence.value_at(points, cues, "user_id", "at", "value").select("event_id", "value")


# Ranking with side conditions.
@query()
def e14_diversity(spark, sf_dir):
    """Ten documents a language by length and quality, a source already chosen costing a tenth."""
    good = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    own = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "lang", "source", "n_chars").join(good, "doc_id", "left")
    score = 0.6 * F.least(F.lit(1.0), F.col("n_chars") / 5000) + 0.4 * F.coalesce("quality", F.lit(0))
    scored = own.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), F.col("source").alias("group_id"), score.alias("score"))
    return rank.diverse(scored, 10, penalty=0.1).withColumnRenamed("query_id", "lang")


@query("WITH s AS (SELECT doc_id, lang, source, 0.55 * least(1, n_chars / 5000) + 0.2 * coalesce(quality, 0) + 0.15 * (1 - coalesce(toxic, 0)) + CASE WHEN lang = 'en' THEN 0.12 ELSE 0 END - CASE WHEN source IS NULL THEN 0.12 ELSE 0 END AS score FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)) SELECT doc_id, round(score, 6) AS score FROM s")
def e13_component_score(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    own = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")
    parts = {
        "size": 0.55 * F.least(F.lit(1.0), F.col("n_chars") / 5000),
        "quality": 0.2 * F.coalesce("quality", F.lit(0)),
        "clean": 0.15 * (1 - F.coalesce("toxic", F.lit(0))),
        "language": F.when(F.col("lang") == "en", 0.12).otherwise(0.0),
        "origin": -F.when(F.col("source").isNull(), 0.12).otherwise(0.0),
    }
    return rank.components(own, parts).select("doc_id", F.round("score", 6).alias("score"))


# State as rewrites.
_CHANGES = "SELECT event_id, user_id, event_type, ts, floor(value / 100) AS content, row_number() OVER w AS n, lag(floor(value / 100)) OVER w AS old FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)"


@query(f"WITH r AS (SELECT * FROM ({_CHANGES}) WHERE n = 1 OR content IS DISTINCT FROM old) SELECT event_id, lag(event_id) OVER w AS revision_of_id, CASE WHEN lead(event_id) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS status FROM r WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def j03_scd2(spark, sf_dir):
    own = table(spark, sf_dir, "events").withColumn("content", F.floor(F.col("value") / 100))
    return state.revisions(own, ["user_id", "event_type"], "content", "ts", "event_id", id="event_id").select("event_id", "revision_of_id", "status")


@query("SELECT c_custkey AS id, coalesce(n.total, c_acctbal) AS balance FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) n ON o_custkey = c_custkey")
def j01_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("id")).agg(F.round(F.sum("o_totalprice"), 2).alias("balance"))
    return state.upsert(old, new.join(old.select("id"), "id", "left_semi"), ["id"])


@query("SELECT item_id AS id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def j02_insert_ignore(spark, sf_dir):
    old = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return state.insert_ignore(old, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), ["id"])


@query("WITH RECURSIVE below(id, depth) AS (SELECT p_partkey, 0::BIGINT FROM part WHERE p_partkey = 1 UNION ALL SELECT v.p_partkey, b.depth + 1 FROM part v JOIN below b ON v.p_partkey // 3 = b.id AND v.p_partkey <> b.id) SELECT id, depth FROM below")
def j06_lineage(spark, sf_dir):
    """All parts below part 1 where a part's parent is a third of its number."""
    table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_partkey div 3 AS parent").where("id <> parent").createOrReplaceTempView("millrace_lineage")
    return state.descendants(spark, "millrace_lineage", "id", "parent", "id = 1")


@query("SELECT event_id, CASE WHEN last IS NULL THEN 'new' WHEN first <> event_type THEN 'conflict' WHEN event_id - last > 300 THEN 'retry' ELSE 'held' END AS outcome FROM (SELECT event_id, event_type, first_value(event_type) OVER w AS first, lag(event_id) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))")
def j09_claims(spark, sf_dir):
    """A user's events as claims on one request; the event number stands for time."""
    return state.claims(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", 300).select("event_id", "outcome")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 490)")
def j12_delete_by_membership(spark, sf_dir):
    own = table(spark, sf_dir, "events")
    return own.join(own.where("event_type = 'error' and value > 490").select("user_id"), "user_id", "left_anti").select("event_id")


@query("""WITH a AS (SELECT source, doc_id // 1000 AS k, sha256(string_agg(sha256(text), chr(10) ORDER BY doc_id, sha256(text))) AS h, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL),
b AS (SELECT source, k // 1000 AS k, sha256(string_agg(h, chr(10) ORDER BY k)) AS h, sum(n) AS n FROM a GROUP BY source, k // 1000),
c AS (SELECT source, k // 1000 AS k, sha256(string_agg(h, chr(10) ORDER BY k)) AS h, sum(n) AS n FROM b GROUP BY source, k // 1000)
SELECT source, sha256(string_agg(h, chr(10) ORDER BY k)) AS revision, sum(n)::BIGINT AS n FROM c GROUP BY 1""")
def j17_source_revision(spark, sf_dir):
    """One digest a source: of digests of ranges of ids, a thousand to a range, so no task gathers a source's rows."""
    own = table(spark, sf_dir, "documents").where("text is not null").select("source", "doc_id", F.sha2("text", 256).alias("h"))
    return state.revision_digest(own, "source", "doc_id", "h")


@query("SELECT user_id, arg_max(event_type, {'a': event_type = 'error', 'b': ts, 'c': event_id}) AS decision FROM events GROUP BY 1")
def k30_last_writer(spark, sf_dir):
    """Errors override; otherwise the latest event decides."""
    own = table(spark, sf_dir, "events").withColumn("layer", F.col("event_type") == "error")
    return state.last_writer(own, ["user_id"], "event_type", "layer", "ts", "event_id").withColumnRenamed("event_type", "decision")


@query("""WITH RECURSIVE i AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, CASE WHEN length(text) > 300 THEN 0.25::DOUBLE ELSE -0.125::DOUBLE END AS d FROM conversations),
p AS (SELECT conv_id, k, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5 + d)) AS v FROM i WHERE k = 1 UNION ALL SELECT i.conv_id, i.k, least(1.0::DOUBLE, greatest(0.0::DOUBLE, p.v + i.d)) FROM p JOIN i ON i.conv_id = p.conv_id AND i.k = p.k + 1)
SELECT conv_id, round(arg_max(v, k), 6) AS value FROM p GROUP BY 1""")
def k29_clamped_sum(spark, sf_dir):
    return state.clamped_sum(_turns(spark, sf_dir), "conv_id", "turn", F.when(F.length("text") > 300, 0.25).otherwise(-0.125))


# Text functions.
@query("SELECT doc_id, (ceil(octet_length(encode(text)) / 3.0))::BIGINT AS estimate, sha256(text) AS digest FROM documents")
def k19_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate("text").alias("estimate"), F.sha2("text", 256).alias("digest"))


@query(r"WITH a AS (SELECT doc_id, text AS t, regexp_replace(text, '[ \t]+', ' ', 'g') AS u FROM documents), b AS (SELECT *, regexp_replace(u, '\n{2,}', chr(10), 'g') AS v FROM a) SELECT doc_id, v AS text, concat_ws(',', CASE WHEN u <> t THEN 'spaces' END, CASE WHEN v <> u THEN 'lines' END) AS operations FROM b")
def k08_cleaning(spark, sf_dir):
    """Cleaned texts with the names of the steps that changed each."""
    steps = (("spaces", r"[ \t]+", " "), ("lines", r"\n{2,}", "\n"))
    own = table(spark, sf_dir, "documents").select("doc_id", T.cleaned("text", steps).alias("c"))
    return own.select("doc_id", "c.text", F.array_join("c.operations", ",").alias("operations"))


@query("SELECT doc_id, CASE WHEN n_chars <= 32 THEN 'short' WHEN n_chars <= 120 THEN 'medium' ELSE 'long' END AS bucket FROM documents")
def k09_length_bucket(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(n <= 32, "short").when(n <= 120, "medium").otherwise("long").alias("bucket"))


@query("SELECT doc_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.9::DOUBLE - CASE WHEN length(text) < 6 THEN 0.12::DOUBLE ELSE 0 END - CASE WHEN length(text) > 220 THEN 0.08::DOUBLE ELSE 0 END - CASE WHEN contains(text, '#') THEN 0.08::DOUBLE ELSE 0 END)), 6) AS score FROM documents")
def k10_quality_score(spark, sf_dir):
    n = F.length("text")
    cut = lambda c, x: F.when(c, x).otherwise(0.0)
    score = 0.9 - cut(n < 6, 0.12) - cut(n > 220, 0.08) - cut(F.col("text").contains("#"), 0.08)
    return table(spark, sf_dir, "documents").select("doc_id", T.clamp(score, 6).alias("score"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '[\x{3040}-\x{30ff}]') THEN 'ja' WHEN regexp_matches(text, '[\x{4e00}-\x{9fff}]') THEN CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'mixed' ELSE 'zh' END WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' ELSE 'unknown' END AS script FROM documents")
def k12_script(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.script("text").alias("script"))


@query("SELECT conv_id, turn, (('0x' || sha256(text)[1:8])::BIGINT & 2147483647)::BIGINT AS seed FROM conversations")
def k25_seed(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", T.seed_of("text").alias("seed"))


@query(r"SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date' END, CASE WHEN regexp_matches(text, 'https?://') THEN 'link' END, CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'license' END, CASE WHEN regexp_matches(text, '[A-Fa-f0-9]{32,}') THEN 'secret' END) AS reasons FROM documents")
def k33_payload_screens(spark, sf_dir):
    rules = (("[0-9]{4}-[0-9]{2}-[0-9]{2}", "date"), ("https?://", "link"), ("(?i)licen[sc]e", "license"), ("[A-Fa-f0-9]{32,}", "secret"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", T.all_reasons(*[(F.col("text").rlike(p), r) for p, r in rules])).alias("reasons"))


@query("SELECT role, count(*) AS n, round(avg(length(text)), 6) AS mean_size, round(avg(length(text) - length(replace(text, ',', ''))), 6) AS commas, round(avg(contains(text, '?')::INT), 6) AS questions FROM conversations GROUP BY 1")
def k34_profile(spark, sf_dir):
    return _turns(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_size"), F.round(F.avg(T.occurrences("text", ",")), 6).alias("commas"), F.round(F.avg(F.col("text").contains("?").cast("int")), 6).alias("questions"))


_BLANK = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SIZE = rf"CASE WHEN length(x) <= 1000 THEN length(x) WHEN length(regexp_extract(substring(x, 1, 1000), '(?s)^.*[{chunks.MARKS}][{_BLANK}]*')) >= 500 THEN length(regexp_extract(substring(x, 1, 1000), '(?s)^.*[{chunks.MARKS}][{_BLANK}]*')) ELSE 1000 END"


@query(rf"""WITH RECURSIVE lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS most FROM documents WHERE text IS NOT NULL
), placed AS (
  SELECT doc_id, line || CASE WHEN n < most THEN chr(10) ELSE '' END AS x, (coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS a FROM lines
), cut AS (
  SELECT doc_id, a, x, {_SIZE} AS size FROM placed WHERE rtrim(x, chr(10)) <> ''
  UNION ALL
  SELECT doc_id, a, x, {_SIZE} FROM (SELECT doc_id, a + size AS a, substring(x, size + 1) AS x FROM cut WHERE size < length(x))
), held AS MATERIALIZED (
  SELECT doc_id, list(a ORDER BY a) AS ss, list(a + size ORDER BY a) AS es, count(*) AS n FROM cut WHERE size < length(x) OR NOT regexp_matches(x, '^[{_BLANK}]*$') GROUP BY 1
), packed AS (
  SELECT doc_id, 0 AS step, 0::BIGINT AS i, 0::BIGINT AS j, 1::BIGINT AS first, 1::BIGINT AS fresh, false AS owed FROM held
  UNION ALL
  SELECT doc_id, step + 1, first, stop, CASE WHEN k > n THEN n + 1 ELSE least(greatest(len(list_filter(ss, lambda s: s < es[stop] - 120)) + 1, first), stop + 1) END, stop + 1, over
  FROM (SELECT *, CASE WHEN k > n THEN n WHEN over THEN k - 1 ELSE k END AS stop
    FROM (SELECT *, k <= n AND k > first AND es[k] - ss[first] > 1000 AND NOT (owed AND k = fresh) AS over
      FROM (SELECT p.*, h.ss, h.es, h.n, greatest(len(list_filter(h.es, lambda e: e < h.ss[p.first] + 800)) + 1, p.fresh) AS k FROM packed p JOIN held h USING (doc_id) WHERE p.first <= h.n)))
), ranged AS (
  SELECT p.doc_id, step, ss[i] AS a, es[j] AS b, j = n AS ends, substring(text, ss[i] + 1, es[j] - ss[i]) AS x FROM packed p JOIN held USING (doc_id) JOIN documents USING (doc_id) WHERE step > 0
), trimmed AS (
  SELECT doc_id, step, a, b, a + length(x) - length(regexp_replace(x, '^[{_BLANK}]+', '')) AS start_char, a + length(regexp_replace(x, '[{_BLANK}]+$', '')) AS end_char, step = max(step) OVER (PARTITION BY doc_id) AS last
  FROM ranged WHERE NOT regexp_matches(x, '^[{_BLANK}]*$')
), kept AS (
  SELECT *, lag(start_char) OVER w AS pa, lag(end_char) OVER w AS pb FROM trimmed WINDOW w AS (PARTITION BY doc_id ORDER BY step)
)
SELECT k.doc_id, row_number() OVER (PARTITION BY k.doc_id ORDER BY step) - 1 AS chunk_index, substring(text, start_char + 1, end_char - start_char) AS text, start_char, end_char
FROM kept k JOIN documents d USING (doc_id) WHERE NOT (last AND pa IS NOT DISTINCT FROM a AND pb IS NOT DISTINCT FROM b)""")
def k02_chunks(spark, sf_dir):
    """Chunks of whole documents with their places; each is the text's own slice."""
    return chunks.chunks(table(spark, sf_dir, "documents"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), s AS (SELECT *, sum(CASE WHEN n = 1 OR length(line) > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM l)
SELECT doc_id, section::BIGINT AS section, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM s GROUP BY ALL""")
def p03_sections(spark, sf_dir):
    """Lines grouped into sections that a long line opens."""
    return extract.sections(table(spark, sf_dir, "documents"), "doc_id", "text", lambda line: F.length(line) > 120).select("doc_id", "section", "lines", "chars")


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string(x[2:4], chr(10)) AS excerpt, CASE WHEN len(x) >= 2 THEN length(x[1]) + 1 END AS start_char FROM l")
def a11_line_slice(spark, sf_dir):
    """Lines two to four of each text and where they start."""
    return extract.line_slice(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text", 2, 4)


@query("""WITH t AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, text AS prompt, nt AS response FROM t WHERE role = 'user' AND nr = 'assistant' AND length(trim(nt)) > 0""")
def k07_dialogue_pairs(spark, sf_dir):
    return extract.dialogue_pairs(_turns(spark, sf_dir), "conv_id", "turn", "role", "text")


@query()
def k01_segmented(spark, sf_dir):
    """Documents without their spaces, cut into words again by a dictionary of the documents: words, words found, and words that agree."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = segmentation.segmenter(segmentation.dictionary(docs))
    return segmentation.recovery(docs, docs.withColumn("text", F.regexp_replace("text", "[ \\t]+", "")), model)


_NEGATIONS = ("not", "no", "nicht", "kein", "pas", "ne", "nunca")
_REPORTS = ("said", "sagte", "dit", "dijo", "that", "que")
_LISTED = lambda words: ", ".join(f"'{w}'" for w in words)


@query(rf"""WITH quoted AS (
  SELECT doc_id, unnest(regexp_split_to_array(lower(text), '["“”„]')) AS part, generate_subscripts(regexp_split_to_array(lower(text), '["“”„]'), 1) % 2 = 0 AS quoted FROM documents
), clauses AS (
  SELECT row_number() OVER () AS c, quoted, x FROM (SELECT quoted, unnest(regexp_split_to_array(part, '[.,;:!?\n。，；：！？]')) AS x FROM quoted)
), words AS (
  SELECT c, quoted, unnest(regexp_extract_all(x, '\p{{L}}+')) AS w, generate_subscripts(regexp_extract_all(x, '\p{{L}}+'), 1) AS n FROM clauses
), rules AS (
  SELECT w AS phrase FROM words WHERE w NOT IN ({_LISTED(_NEGATIONS + _REPORTS)}) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10000
), scoped AS (
  SELECT w, quoted, n > coalesce(min(n) FILTER (w IN ({_LISTED(_NEGATIONS)})) OVER (PARTITION BY c), n) AS negated, n > coalesce(min(n) FILTER (w IN ({_LISTED(_REPORTS)})) OVER (PARTITION BY c), n) AS reported FROM words
)
SELECT phrase, count(*) AS n, count(*) FILTER (negated) AS negated, count(*) FILTER (reported) AS reported, count(*) FILTER (quoted) AS quoted FROM scoped JOIN rules ON w = phrase GROUP BY 1""")
def k15_scoped_rules(spark, sf_dir):
    """The 10,000 most frequent words as rules, all matched at once: how often each stands in the documents, and of these how often negated, reported and quoted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scopes = spark.createDataFrame([(-1, w, label, True) for label, ws in (("negation", _NEGATIONS), ("reported", _REPORTS)) for w in ws], "rule_id long, phrase string, label string, whole boolean")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("phrase")).where(~F.col("phrase").isin([*_NEGATIONS, *_REPORTS]))
    frequent = words.groupBy("phrase").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "phrase").limit(10000)
    rules = frequent.select(F.xxhash64("phrase").alias("rule_id"), "phrase", F.col("phrase").alias("label"), F.lit(True).alias("whole")).unionByName(scopes)
    tally = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    return patterns.extract(docs, rules).groupBy(F.col("label").alias("phrase")).agg(F.count("*").alias("n"), *map(tally, ("negated", "reported", "quoted")))
