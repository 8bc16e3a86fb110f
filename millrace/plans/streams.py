"""Structured Streaming over replayed events, run until the input is used up, and the same results in batch."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.plans.catalog import query, table
from millrace.streaming import jobs, timers


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 256")
def m01_event_log(spark, sf_dir):
    """The last 256 events of each user with their sequence numbers."""
    w = Window.partitionBy("user_id")
    own = table(spark, sf_dir, "events").withColumn("sequence", F.row_number().over(w.orderBy("ts", "event_id")).cast("long"))
    return own.withColumn("back", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id")))).where("back <= 256").select("user_id", "event_id", "sequence")


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n > 20")
def m02_resume(spark, sf_dir):
    """What a consumer that has seen 20 events of each user still has to read."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("n", n).where("n > 20").select("event_id", "user_id")


@query("SELECT event_id, user_id, event_type, value FROM events")
def m03_exactly_once(spark, sf_dir):
    """Every event sent twice and streamed: duplicates by id within the watermark are dropped."""
    events = table(spark, sf_dir, "events")
    return jobs.exactly_once(spark, events.unionByName(events), "event_id", "ts").select("event_id", "user_id", "event_type", "value")


@query("SELECT user_id, count(*) AS n, max(event_id) AS consumed FROM events GROUP BY 1")
def m04_receipts(spark, sf_dir):
    """Every receipt sent twice and streamed: each counts once, and the furthest one is kept, for each user."""
    own = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return jobs.receipts(spark, own.unionByName(own))


@query("SELECT event_type, epoch_ms(date_trunc('hour', ts)) AS hour_ms, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def m15_tumbling(spark, sf_dir):
    """Counts and sums of hourly windows, streamed with a watermark."""
    return jobs.tumbling(spark, table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS recent FROM events")
def m10_trailing_count(spark, sf_dir):
    """Events of the same user in the 24 hours up to each."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    return table(spark, sf_dir, "events").withColumn("us", us).select("event_id", F.count("*").over(w).alias("recent"))


@query("SELECT user_id, (count(*) >= 20 AND count(*) - 12 >= 12)::BOOLEAN AS due, greatest(0, count(*) - 12 - 1)::BIGINT AS covers FROM events GROUP BY 1")
def m11_summary_trigger(spark, sf_dir):
    """A summary is due from 20 events on with 12 new ones; the newest 12 stay out of it."""
    n = F.count("*")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(((n >= 20) & (n - 12 >= 12)).alias("due"), F.greatest(F.lit(0), n - 12 - 1).cast("long").alias("covers"))


@query("SELECT user_id, count(*) FILTER (ms <= first + 172800000) AS kept, count(*) FILTER (ms > first + 172800000) AS late FROM (SELECT user_id, epoch_ms(ts) AS ms, min(epoch_ms(ts)) OVER (PARTITION BY user_id) AS first FROM events) GROUP BY 1")
def m06_late_drop(spark, sf_dir):
    """Events against a two-day deadline after their user's first: late ones are dropped, the rest counted."""
    return jobs.deadlines(spark, table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), 2 * 86_400_000)


@query("""WITH j AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS job, min(epoch_us(ts) // 1000) AS started, min(epoch_us(ts) // 1000) FILTER (event_type = 'error') AS cancelled, min(epoch_us(ts) // 1000) FILTER (event_type = 'purchase') AS completed FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL GROUP BY 1),
d AS (SELECT *, least(cancelled, completed, started + 21600000) AS at_ms FROM j)
SELECT job, CASE WHEN cancelled = at_ms THEN 'cancelled' WHEN completed = at_ms THEN 'completed' ELSE 'timed_out' END AS status, at_ms FROM d""")
def m06_timeouts(spark, sf_dir):
    """A user's day as a job: a purchase completes it, an error cancels it, and a timer ends it six hours after its first event."""
    job = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "cancelled")
    return timers.endings(spark, table(spark, sf_dir, "events"), 21_600_000, F.when(F.col("user_id").isNotNull(), job), kind)
