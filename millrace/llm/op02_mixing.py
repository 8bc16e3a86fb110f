"""Mixing sources to target weights by pivotal dependent rounding.

Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all words; a target stops at
twice its source's words and the excess goes to the others by weight until none is above. Every document of a source
then has the same expected number of copies, target / source words: its whole part is taken, and the fractional
parts are rounded together. Two documents at a time move words between their probabilities, in a random direction
that keeps both expectations, until one of the two is integral; so a source's expected words stay constant to the
last pair. Rows are dealt into buckets by a hash of their id, each bucket leaves one fractional document a source,
and these residuals meet in a reduction tree of FAN buckets a node until one remains, which is drawn by its own probability, so
every document keeps its expected copies: a source misses its target by less than one document. Long documents pair
first, so that the one that is left over tends to be short.

Random numbers come from hashes of ids, sizes and levels, so reruns agree. Null texts and texts without words have
size 0 and take nothing; an empty table gives no rows. Texts of any length are counted whole. Documents of equal size
pair in the order of their ids. Repeated rows count as documents of their own; equal ones are interchangeable. Only the
columns doc_id, text and source are read, whatever others are named. A bucket is a hash of id and size: rows that are
equal in both share one, so a single repeated id must fit a task.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import stash, table

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
ROWS = 2000  # a bucket, about
FAN = 64
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size in words) of each document."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): the level at which capped sources and weighted ones add up to the whole share."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    own = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    own = own.withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    own = own.withColumn("level", (F.sum("source_size").over(everything) * share - before) / rest)
    # The level rises as long as the next source is capped below it, and falls from then on: the highest one holds.
    own = own.withColumn("level", F.max("level").over(everything))
    return own.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def round_group(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after pairing: all 0 or 1 but for one at most; the sum of size x probability stays."""
    p = p.astype(float).copy()
    held = -1
    for i in np.flatnonzero((p > 1e-12) & (p < 1 - 1e-12)).tolist():
        if held < 0:
            held = i
            continue
        a, b, pa, pb = size[held], size[i], p[held], p[i]
        up, down = min((1 - pa) * a, pb * b), min(pa * a, (1 - pb) * b)
        move = up if rng.random() * (up + down) < down else -down
        pa, pb = pa + move / a, pb - move / b
        p[held], p[i] = pa, pb
        whole_a, whole_b = pa < 1e-12 or pa > 1 - 1e-12, pb < 1e-12 or pb > 1 - 1e-12
        held = -1 if whole_a and whole_b else i if whole_a else held
    near = (p < 1e-12) | (p > 1 - 1e-12)
    p[near] = np.round(p[near])
    return p


def _level(level: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["source", "size", "doc_id", "copies"], ascending=[True, False, True, True], na_position="last").reset_index(drop=True)
        p = rows["p"].to_numpy(dtype=float, copy=True)
        size = rows["size"].to_numpy(dtype=float)
        for source, at in rows.groupby("source", dropna=False, sort=False).indices.items():
            key = [level, int(rows["bucket"].iloc[0]), zlib.crc32(str(source).encode("utf-8", "replace"))]
            rng = np.random.default_rng(key)
            p[at] = round_group(size[at], p[at], rng)
            if last:  # one fractional document is left at most
                open_ = at[(p[at] > 0) & (p[at] < 1)]
                p[open_] = rng.random(len(open_)) < p[open_]
        rows["p"] = p
        return rows

    return run


_SCHEMA = "doc_id long, source string, size long, source_size long, target double, copies long, p double, bucket long"


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of docs (doc_id, source, text)."""
    sizes = stash(sized(docs), "sizes")
    rows = sizes.count()
    own = sizes.join(targets(sizes, weights, share, most).withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    buckets = max(1, math.ceil(rows / ROWS))
    own = own.select("doc_id", "source", "size", "source_size", "target", F.floor(rate).cast("long").alias("copies"), F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0).alias("p"))
    own = own.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)).cast("long"))
    done, level = None, 0
    while True:
        out = stash(own.groupBy("bucket").applyInPandas(_level(level, buckets == 1), _SCHEMA), "rounded")
        whole = out.where("p = 0 or p = 1")
        done = whole if done is None else done.unionByName(whole)
        if buckets == 1:
            break
        own = out.where("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))
        buckets, level = math.ceil(buckets / FAN), level + 1
    copies = F.col("copies") + F.col("p").cast("long")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
