"""Jobs that end by an event or by their deadline: one terminal row each, decided by event time.

A job is a key. It starts with its first event and ends with the earliest of a cancellation, a result and its deadline;
at one instant a cancellation beats a result, and both beat the deadline. Events may come in any order within the
watermark's delay: the state holds only the earliest of each kind, and a timer stands at the decision they imply. When
the watermark passes it, nothing earlier can come any more, the terminal row is written, and results that come later
find the job closed. A closed job's state goes with a second timer, `keep` after its end.

Deadlines holds one job a key. A stream of many short jobs deals them into buckets by hash (Buckets): a bucket's jobs are
one value of state with one timer, at the earliest of their decisions, so calls between Spark and Python, a few for each
key and batch, grow with the buckets and not with the jobs.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.streaming.jobs import drain, replay, rocksdb

CANCELLED, COMPLETED, TIMED_OUT = "cancelled", "completed", "timed_out"
_EMPTY = "spark.sql.streaming.noDataMicroBatches.enabled"
_PLACE = {CANCELLED: 0, COMPLETED: 1, TIMED_OUT: 2}
BUCKETS = 2048  # of a stream's jobs: a bucket's state is read and written whole, about 40 bytes a live job
_NEVER = np.iinfo(np.int64).max
_HELD = ["start", CANCELLED, COMPLETED]


class Deadlines(StatefulProcessor):
    """Rows (job, at_ms, kind), kind one of cancelled, completed or null, to (job, status, at_ms)."""

    def __init__(self, limit_ms: int, keep_ms: int):
        self.limit_ms, self.keep_ms = limit_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "start long, cancelled long, completed long, timer long, closed boolean")

    def _decision(self, start: int, cancelled: int | None, completed: int | None) -> tuple[int, int, str]:
        found = [(cancelled, CANCELLED), (completed, COMPLETED), (start + self.limit_ms, TIMED_OUT)]
        return min((at, _PLACE[kind], kind) for at, kind in found if at is not None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, cancelled, completed, timer, closed = self.state.get() if self.state.exists() else (None,) * 4 + (False,)
        if closed or key[0] is None:
            return iter(())
        for part in rows:
            first = {None: part["at_ms"].min()} | part.groupby("kind")["at_ms"].min().to_dict()
            start, cancelled, completed = (least(a, first.get(k)) for a, k in ((start, None), (cancelled, CANCELLED), (completed, COMPLETED)))
        at, _, _ = self._decision(start, cancelled, completed)
        if at != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
        self.state.update((start, cancelled, completed, at, False))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, cancelled, completed, _, closed = self.state.get()
        if closed:
            self.state.clear()
            return iter(())
        at, _, status = self._decision(start, cancelled, completed)
        self.handle.registerTimer(at + self.keep_ms)
        self.state.update((start, cancelled, completed, at + self.keep_ms, True))
        return iter([pd.DataFrame({"job": [key[0]], "status": [status], "at_ms": [at]})])

    def close(self) -> None:
        pass


class Buckets(StatefulProcessor):
    """Deadlines for keys that hold many jobs: rows (job, at_ms, kind) of a bucket to (job, status, at_ms)."""

    def __init__(self, limit_ms: int, keep_ms: int):
        self.limit_ms, self.keep_ms = limit_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("jobs", "jobs binary, timer long")

    def _load(self) -> tuple[pd.DataFrame, int | None]:
        """The bucket's jobs by name, with the earliest of each kind (_NEVER without one), and its timer."""
        if not self.state.exists():
            return pd.DataFrame({c: np.empty(0, np.int64) for c in _HELD} | {"closed": np.empty(0, bool)}, index=pd.Index([], dtype=object)), None
        packed, timer = self.state.get()
        table = pa.ipc.open_stream(packed).read_all()
        own = {c: table.column(c).to_numpy() for c in (*_HELD, "closed")}
        return pd.DataFrame(own, index=pd.Index(table.column("job").to_pylist(), dtype=object)), timer

    def _save(self, jobs: pd.DataFrame, timer: int | None, fired: bool = False) -> None:
        due = None if jobs.empty else int((self._ends(jobs) + np.where(jobs["closed"], self.keep_ms, 0)).min()) + 1  # when the watermark is past it
        if fired or due != timer:
            if timer is not None and not fired:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if due is None:
            self.state.clear()
            return
        table = pa.table({"job": pa.array(jobs.index, pa.string())} | {c: jobs[c].to_numpy() for c in (*_HELD, "closed")})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(), due))

    def _ends(self, jobs: pd.DataFrame) -> np.ndarray:
        return np.minimum(np.minimum(jobs[CANCELLED].to_numpy(), jobs[COMPLETED].to_numpy()), jobs["start"].to_numpy() + self.limit_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [p[["job", "at_ms", "kind"]] for p in rows]
        new = pd.concat(parts)
        new = new[new["job"].notna()]
        if new.empty:
            return iter(())
        jobs, timer = self._load()
        at = new["at_ms"].to_numpy(np.int64)
        own = {"job": new["job"].to_numpy(), "start": at} | {c: np.where((new["kind"] == c).to_numpy(), at, _NEVER) for c in (CANCELLED, COMPLETED)}
        found = pd.DataFrame(own).groupby("job", sort=False).min()
        closed = found.index.isin(jobs.index[jobs["closed"].to_numpy()])
        every = pd.concat([jobs, found[~closed].assign(closed=False)])
        self._save(every.groupby(level=0, sort=False).agg({c: "min" for c in _HELD} | {"closed": "max"}) if len(jobs) else every, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        jobs, timer = self._load()
        if expiredTimerInfo.getExpiryTimeInMs() != timer:
            return iter(())
        end, closed = self._ends(jobs), jobs["closed"].to_numpy()
        due, gone = ~closed & (end < now), closed & (end + self.keep_ms < now)
        status = np.where(jobs[CANCELLED] == end, CANCELLED, np.where(jobs[COMPLETED] == end, COMPLETED, TIMED_OUT))
        out = pd.DataFrame({"job": jobs.index[due], "status": status[due], "at_ms": end[due]})
        self._save(jobs.assign(closed=closed | due)[~gone], timer, fired=True)
        return iter([out] if len(out) else [])

    def close(self) -> None:
        pass


def least(a: int | None, b) -> int | None:
    known = [int(x) for x in (a, b) if x is not None and not pd.isna(x)]
    return min(known) if known else None


@contextlib.contextmanager
def only_with_data(spark: SparkSession):
    """No batches without data: timers then fire with the next rows, so a replay has as many batches as parts."""
    before = spark.conf.get(_EMPTY)
    spark.conf.set(_EMPTY, "false")
    try:
        yield
    finally:
        spark.conf.set(_EMPTY, before)


def terminal(stream: DataFrame, limit_ms: int, keep_ms: int, delay: str) -> DataFrame:
    """(job, status, at_ms) of a stream (job, ts, kind): one row for each job that has ended. Rows without a job are
    heartbeats: they move the watermark and nothing else. No filter may drop them, as it would be pushed below the watermark."""
    bucket = F.pmod(F.xxhash64("job"), F.lit(BUCKETS)).alias("bucket")
    rows = stream.withWatermark("ts", delay).select("job", "ts", F.unix_millis("ts").alias("at_ms"), "kind", bucket)
    return rows.groupBy("bucket").transformWithStateInPandas(Buckets(limit_ms, keep_ms), "job string, status string, at_ms long", "Append", "EventTime")


def endings(spark: SparkSession, rows: DataFrame, limit_ms: int, job: Column, kind: Column, ts: str = "ts", keep_ms: int = 86_400_000, delay: str = "0 seconds", parts: int = 2) -> DataFrame:
    """(job, status, at_ms) of every job in a table that is replayed as a stream, part after part from one checkpoint.

    Two heartbeats beyond all deadlines let the open timers fire: the first moves the watermark, and with the second comes
    a batch that sees it. Rows without a time or a job are passed over, kinds
    other than cancelled and completed only start a job, and repeated rows change nothing. A table without rows has no jobs.
    """
    own = rows.where(F.col(ts).isNotNull()).select(job.cast("string").alias("job"), F.col(ts).cast("timestamp").alias("ts"), kind.alias("kind"))
    own = own.where("job IS NOT NULL").withColumn("kind", F.when(F.col("kind").isin(CANCELLED, COMPLETED), F.col("kind")))
    last = own.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL")
    none = F.lit(None).cast("string")
    beats = [last.select(none.alias("job"), F.timestamp_micros(F.unix_micros("ts") + 1000 * (2 * limit_ms + keep_ms + k)).alias("ts"), none.alias("kind")) for k in (0, 1)]
    with rocksdb(spark), only_with_data(spark):
        streams = [*replay(spark, own, parts=parts), *(p for b in beats for p in replay(spark, b, parts=1))]
        return drain([terminal(s, limit_ms, keep_ms, delay) for s in streams])
