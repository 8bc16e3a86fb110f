"""Streams that replay a table in time order through a file source and end when it is used up.

Each function writes the input as parts of ascending time in the shared folder, runs a query with an availableNow
trigger over one part after the other and returns the table that the query wrote. A long-running deployment passes its
own readStream to the same transformations.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.sources.tables import shared_dir

PARTS = 4
#: Rows that one task deals out to the parts, so files hold a bounded number of rows and their number grows with the table.
ROWS_A_TASK = 1_000_000
LEAST_TASKS = 8


def replay(spark: SparkSession, rows: DataFrame, ts: str = "ts", parts: int = PARTS) -> list[DataFrame]:
    """Streams of the rows, one a part of ascending time: equal times share a part, and rows without a time are in the first.

    Tasks deal the rows out evenly, whatever their keys, and each writes a file of every part. drain() makes each part
    one micro-batch of all its files.
    """
    path = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    cuts, n = rows.select(F.unix_micros(ts).alias("t")).agg(F.percentile_approx("t", [k / parts for k in range(1, parts)], 1000), F.count("*")).head()
    part = F.lit(0)
    for c in cuts or []:
        part = part + (F.unix_micros(ts) > c).cast("int")
    dealt = rows.withColumn("_part", F.coalesce(part, F.lit(0))).repartition(max(LEAST_TASKS, -(-n // ROWS_A_TASK)))
    dealt.write.partitionBy("_part").parquet(path)
    return [spark.readStream.schema(rows.schema).parquet(f"{path}/_part={{{k}}}") for k in range(parts)]  # a pattern may match nothing


def drain(streams: list[DataFrame], mode: str = "append") -> DataFrame:
    """Runs the same stream over one part after the other, from one checkpoint, and returns what it wrote; in update mode each batch is a set of rows with its number `batch`."""
    spark, schema = streams[0].sparkSession, streams[0].schema
    path = f"{shared_dir(spark)}/drain-{uuid.uuid4().hex}"
    none = spark.createDataFrame([], schema)  # a table without rows leaves no batch

    def put(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/out/batch={n}")  # a repeated batch replaces itself

    none.write.parquet(f"{path}/out" if mode == "append" else f"{path}/out/batch=-1")
    for stream in streams:
        writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode)
        writer = writer.format("parquet").option("path", f"{path}/out") if mode == "append" else writer.foreachBatch(put)
        writer.start().awaitTermination()
    return (spark.read.schema(schema) if mode == "append" else spark.read).parquet(f"{path}/out")


def exactly_once(spark: SparkSession, rows: DataFrame, id: str, ts: str, delay: str = "60 days") -> DataFrame:
    """Each row once; copies without a time meet in the first micro-batch."""
    return drain([s.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id]) for s in replay(spark, rows, ts)])


def tumbling(spark: SparkSession, rows: DataFrame, delay: str = "2 days") -> DataFrame:
    """(event_type, hour_ms, n, total): the last state of each window over all micro-batches.

    Rows without a time are in no window; they are counted apart, under a null hour_ms.
    """
    w = F.window("ts", "1 hour")
    kinds = [F.count("*").alias("n"), F.sum("value").alias("total")]
    streams = [s.withWatermark("ts", delay).groupBy("event_type", w).agg(*kinds) for s in replay(spark, rows.where("ts is not null"))]
    out = drain([s.select("event_type", F.unix_millis("window.start").alias("hour_ms"), "n", "total") for s in streams], "update")
    best = out.groupBy("event_type", "hour_ms").agg(F.max_by(F.struct("n", "total"), "batch").alias("x")).select("event_type", "hour_ms", "x.n", "x.total")
    untimed = rows.where("ts is null").groupBy("event_type").agg(*kinds).select("event_type", F.lit(None).cast("long").alias("hour_ms"), "n", "total")
    return best.unionByName(untimed).withColumn("total", F.round("total", 6))


def receipts(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(user_id, n, consumed): the receipts of each user and the furthest one.

    A receipt that comes again, in the same micro-batch or a later one, counts once: copies are dropped by id within the
    watermark before anything is counted. Receipts without an id cannot be told apart; each counts.
    """
    once = exactly_once(spark, rows.where("event_id is not null"), "event_id", "ts")
    every = once.unionByName(rows.where("event_id is null").withColumn("ts", F.col("ts").cast("timestamp")))
    return every.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("consumed"))


def _deadline(limit_ms: int) -> Callable:
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, kept, late = state.get if state.exists else (None, 0, 0)
        first, times, counts = known, np.empty(0, np.int64), np.empty(0, np.int64)
        for rows in parts:  # in any order within a micro-batch, so times up to the deadline wait for the earliest
            at = rows["ts"].dropna().astype("datetime64[ms]").astype("int64").to_numpy()
            if not len(at):
                continue
            if known is None:
                first = int(at.min()) if first is None else min(first, int(at.min()))
            times, where = np.unique(np.concatenate([times, at]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, np.ones(len(at), np.int64)])).astype(np.int64)
            over = times > first + limit_ms
            late, times, counts = late + int(counts[over].sum()), times[~over], counts[~over]
        kept += int(counts.sum())
        state.update((first, kept, late))
        yield pd.DataFrame({"user_id": [key[0]], "kept": [kept], "late": [late]})

    return run


def deadlines(spark: SparkSession, rows: DataFrame, limit_ms: int) -> DataFrame:
    """(user_id, kept, late): events up to and beyond a deadline after the user's first one; an event without a time is neither."""
    schema, kept = "user_id long, kept long, late long", "first long, kept long, late long"
    streams = replay(spark, rows)
    out = drain([s.groupBy("user_id").applyInPandasWithState(_deadline(limit_ms), schema, kept, "update", GroupStateTimeout.NoTimeout) for s in streams], "update")
    return out.groupBy("user_id").agg(F.max_by("kept", "batch").alias("kept"), F.max_by("late", "batch").alias("late"))


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """A state store on disk, which large states and timers need; the session's own setting comes back afterwards."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def committed(spark: SparkSession, rows: DataFrame, id: str, effect: Callable[[DataFrame], DataFrame], ts: str = "ts") -> DataFrame:
    """What effect(rows) gives, once for each id, though rows come again and batches are replayed.

    The ids that have come are the stream's state, so a batch looks up its own ids only; its effects are one folder, which
    a repeated batch replaces. State and folder belong to one batch of one checkpoint: they stand or fall together. Rows
    with one id are deliveries of one turn and taken to be equal; rows without an id are one turn.
    """
    path = f"{shared_dir(spark)}/committed-{uuid.uuid4().hex}"
    spark.createDataFrame([], effect(rows).schema).write.parquet(f"{path}/out/batch=-1")

    def put(batch: DataFrame, n: int) -> None:
        effect(batch).write.mode("overwrite").parquet(f"{path}/out/batch={n}")

    with rocksdb(spark):
        for stream in replay(spark, rows, ts):
            once = stream.dropDuplicates([id])
            once.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")
