"""What the operators of this subpackage share: tables, lineage cuts, samples and Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: What a Python worker keeps from task to task, such as a tokenizer with the words it has met.
KEPT: dict = {}


def settle(drop: bool = True) -> None:
    """Drops what a worker keeps for other operators, if asked to, and gives back what its allocators hold.

    A worker serves one stage after another, and an executor's workers share little memory with its JVM.
    """
    if drop:
        KEPT.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); unset in a local session, as in tests, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared folder and reads it back: later stages survive the loss of any executor."""
    path = f"{shared_dir(df.sparkSession)}/millrace/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(column="doc_id"):
    """True where crc32 of the id as text is divisible by 5; a null id is held out too."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(True))


def bounded_sample(rows: DataFrame, n: int, seed: int = 0, key: str = "doc_id") -> list:
    """At most n distinct keys with the smallest hashes: the same on every run, whatever the partitions."""
    picked = rows.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
    return [r[0] for r in picked.collect()]


def one_each(rows: DataFrame, key: str, by: str) -> DataFrame:
    """One row of each key: the one whose `by` has the smallest hash (equal ones: the smallest), the same on every run."""
    rest = [c for c in rows.columns if c != key]
    first = F.min(F.struct(F.xxhash64(by).alias("_hash"), *[F.col(c) for c in [by, *[c for c in rest if c != by]]])).alias("_first")
    return rows.groupBy(key).agg(first).select(*[c if c == key else f"_first.{c}" for c in rows.columns])


def batches(it: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Splits Arrow batches so that a text column's bytes stay near `most`; one longer text comes alone."""
    from millrace.llm.shingles import slices

    for batch in it:
        for a, b in slices(batch.column(batch.schema.get_field_index(column)), most):
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
