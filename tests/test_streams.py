"""Streams over events without a time, in several files a part, against the SQL of their queries."""

import datetime as dt

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from millrace.streaming import jobs
from tests import oracle

STREAMS = ("m03_exactly_once", "m04_receipts", "m06_late_drop", "m15_tumbling")
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def _check(spark, tmp_path, rows, name):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    oracle.compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path))


@pytest.mark.parametrize("name", STREAMS)
def test_rows_without_a_time_count(spark, tmp_path, name):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 7 == 0 or i % 5 == 4 else at + dt.timedelta(hours=(i * 37) % 200), i % 5, "ab"[i % 2], i / 4) for i in range(80)]
    _check(spark, tmp_path, rows, name)  # all of user 4's events are without a time


@pytest.mark.parametrize("name", STREAMS)
def test_tables_without_rows_or_times(spark, tmp_path, name):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    _check(spark, tmp_path / "a", [], name)
    _check(spark, tmp_path / "b", [(1, None, 1, "a", 1.0), (2, None, 2, "b", 2.0)], name)


def test_a_part_has_several_files_and_parts_ascend(spark):
    rows = spark.range(4000).selectExpr("id", "timestamp_seconds((id * 7919) % 4000) as ts")
    parts = [spark.read.schema(s.schema).parquet(*_files(s)) for s in jobs.replay(spark, rows)]
    assert sum(p.count() for p in parts) == 4000
    assert all(len(p.inputFiles()) > 1 for p in parts)
    spans = [p.selectExpr("min(ts)", "max(ts)").first() for p in parts]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def _files(stream):
    out = jobs.drain([stream.selectExpr("id", "ts", "input_file_name() as file")])
    return [r.file for r in out.select("file").distinct().collect()]


def test_the_first_event_may_come_in_a_later_chunk():
    class State:
        exists = False

        def update(self, x):
            self.kept = x

    chunk = lambda *ms: pd.DataFrame({"ts": pd.to_datetime(list(ms), unit="ms")})
    state = State()
    found = list(jobs._deadline(10)((1,), iter([chunk(25, 30, 36), chunk(20, 31)]), state))
    assert (found[0]["kept"][0], found[0]["late"][0], state.kept) == (3, 2, (20, 3, 2))


def test_a_receipt_that_comes_again_counts_once(spark):
    """In the same part of the stream, in a later one, and without a time; receipts without an id count each."""
    at = dt.datetime(2024, 1, 1)
    own = [(1, i, at + dt.timedelta(hours=i)) for i in range(40)]
    again = [(1, i, at + dt.timedelta(hours=i + 30)) for i in range(0, 40, 3)] + [(1, 5, at + dt.timedelta(hours=5))]
    rows = own + again + [(2, 90, None), (2, 90, None), (2, None, at), (2, None, at), (3, None, None)]
    found = jobs.receipts(spark, spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 40, 39), (2, 3, 90), (3, 1, None)]


def test_effects_are_written_once_for_an_id_in_any_batch(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(i % 25, at + dt.timedelta(hours=i)) for i in range(100)]
    out = jobs.committed(spark, spark.createDataFrame(rows, "event_id long, ts timestamp_ntz"), "event_id", lambda d: d.select("event_id"))
    assert sorted(r.event_id for r in out.collect()) == list(range(25))
