import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.streaming import jobs, timers

AT = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "job string, ts timestamp, kind string"


def at(ms: int) -> dt.datetime:
    return AT + dt.timedelta(milliseconds=ms)


def plain(rows, limit: int) -> list[tuple]:
    out, base = [], int(AT.timestamp() * 1000)
    for job in sorted({j for j, t, _ in rows if j is not None and t is not None}):
        own = [(round((t - AT).total_seconds() * 1000), k) for j, t, k in rows if j == job and t is not None]
        found = [(t, 0, k) for t, k in own if k == "cancelled"] + [(t, 1, k) for t, k in own if k == "completed"]
        t, _, k = min([*found, (min(t for t, _ in own) + limit, 2, "timed_out")])
        out.append((job, k, base + t))
    return out


def test_every_job_ends_once(spark):
    rng = np.random.default_rng(5)
    kinds = ["cancelled", "completed", None, "other"]
    rows = [(f"j{rng.integers(30)}", at(int(rng.integers(0, 5000))), kinds[rng.choice(4, p=[0.05, 0.1, 0.5, 0.35])]) for _ in range(200)]
    rows += [("tie", at(10), None), ("tie", at(20), "completed"), ("tie", at(20), "cancelled"), ("due", at(0), None), ("due", at(1000), "completed")]
    rows += [("quiet", at(1), None), ("late", at(0), None), ("late", at(4000), "completed"), ("late", at(4000), "completed")]
    rows += [(None, at(3), "completed"), ("none", None, "cancelled")]
    found = timers.endings(spark, spark.createDataFrame(rows, SCHEMA), 1000, F.col("job"), F.col("kind"), keep_ms=10_000)
    got = sorted(tuple(r) for r in found.collect())
    assert got == plain(rows, 1000)
    status = {j: s for j, s, _ in got}
    assert (status["tie"], status["due"], status["quiet"], status["late"]) == ("cancelled", "completed", "timed_out", "timed_out")
    assert spark.conf.get(jobs._STORE) != jobs._ROCKS and spark.conf.get(timers._EMPTY) == "true"


def test_no_rows(spark):
    assert timers.endings(spark, spark.createDataFrame([], SCHEMA), 1000, F.col("job"), F.col("kind")).count() == 0


def test_rows_that_are_late_within_the_delay(spark):
    """A stream out of order: each part is a micro-batch, and an earlier cancellation comes after the result."""
    batches = [[("a", at(0), None), ("a", at(300), "completed"), ("b", at(0), None)], [("a", at(200), "cancelled"), ("b", at(900), None)], [("b", at(950), "completed"), (None, at(9000), None)]]
    parts = [jobs.replay(spark, spark.createDataFrame(b, SCHEMA), parts=1)[0] for b in batches]
    with jobs.rocksdb(spark):
        found = jobs.drain([timers.terminal(p, 1000, 100, "1 second") for p in parts])
    base = int(AT.timestamp() * 1000)
    assert sorted(tuple(r) for r in found.collect()) == [("a", "cancelled", base + 200), ("b", "completed", base + 950)]


class Handle:
    """The state and timers of one key, for a closed job's sake."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def clear(self):
        self.value = None

    def registerTimer(self, t):
        self.timers.append(t)

    def deleteTimer(self, t):
        self.timers.remove(t)


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_state_in_any_order_and_its_end(order):
    p, h = timers.Deadlines(100, 50), Handle()
    p.init(h)
    rows = [(0, None), (40, "completed"), (30, "cancelled")]
    for k in order:
        list(p.handleInputRows(("x",), iter([pd.DataFrame([rows[k]], columns=["at_ms", "kind"])]), None))
    assert h.timers == [30]
    h.timers.clear()
    assert [tuple(d.iloc[0]) for d in p.handleExpiredTimer(("x",), None, None)] == [("x", "cancelled", 30)]
    list(p.handleInputRows(("x",), iter([pd.DataFrame([(99, "completed")], columns=["at_ms", "kind"])]), None))
    assert h.timers == [80] and h.value[-1]
    assert list(p.handleExpiredTimer(("x",), None, None)) == [] and h.value is None


class Now:
    """The watermark and the expired timer that a processor is told."""

    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.ms


def test_a_bucket_of_jobs_equals_a_key_for_each_job():
    rng = np.random.default_rng(8)
    kinds = ["cancelled", "completed", None, "other"]
    rows = [(f"j{rng.integers(40)}", int(t), kinds[rng.choice(4, p=[0.1, 0.2, 0.4, 0.3])]) for t in np.sort(rng.integers(0, 2000, 300))]
    want, got = [], []
    bucket, h = timers.Buckets(100, 50), Handle()
    bucket.init(h)
    single = {}
    for now in [*range(0, 2400, 100)]:  # batches of 100 ms; the watermark is their start
        own = [r for r in rows if now <= r[1] < now + 100]
        batch = pd.DataFrame([*own, (None, now, None)], columns=["job", "at_ms", "kind"])
        assert list(bucket.handleInputRows((0,), iter([batch.iloc[:7], batch.iloc[7:]]), None)) == []
        for job, part in pd.DataFrame(own, columns=["job", "at_ms", "kind"]).groupby("job"):
            if job not in single:
                single[job] = (timers.Deadlines(100, 50), Handle())
                single[job][0].init(single[job][1])
            single[job][0].handleInputRows((job,), iter([part]), None)
        for job, (p, own_handle) in single.items():
            for t in [t for t in own_handle.timers if t < now]:
                want += [tuple(r) for d in p.handleExpiredTimer((job,), None, None) for r in d.itertuples(index=False)]
                own_handle.timers.remove(t)
        for t in [t for t in h.timers if t <= now]:
            info = Now(now)
            info.getExpiryTimeInMs = lambda t=t: t
            got += [tuple(r) for d in bucket.handleExpiredTimer((0,), Now(now), info) for r in d.itertuples(index=False)]
            h.timers.remove(t)
        assert len(h.timers) <= 1  # one timer, however many jobs
    assert sorted(got) == sorted(want) and len(want) > 40
    assert h.value is None  # all closed and gone


def test_calls_for_state_do_not_grow_with_jobs():
    bucket, h = timers.Buckets(100, 50), Handle()
    bucket.init(h)
    calls = []
    for name in ("exists", "get", "update", "registerTimer", "deleteTimer"):
        setattr(h, name, lambda *a, f=getattr(h, name), name=name: (calls.append(name), f(*a))[1])
    bucket.handleInputRows((0,), iter([pd.DataFrame({"job": [f"j{k}" for k in range(5000)], "at_ms": range(5000), "kind": None})]), None)
    assert len(calls) <= 5
