"""Near duplicates among embeddings: spherical k-means cells, blocked cosine products inside cells.

Centres are fitted on at most MAX_TRAINING vectors; every vector then goes to the cell of its nearest centre, and
also visits each lower-numbered cell whose border is near enough to hide a partner: with angle a of the threshold, a
partner in cell c exists only if (x.own - x.c) <= sin(a) |own - c|. So each pair at or above the threshold meets in
exactly one cell, and none is missed. Where vectors fill their space evenly (random ones, in many dimensions), most
borders are that near and the products cover most pairs; clustered vectors visit few cells. A cell deals those at home
and its visitors into blocks of about BLOCK rows, and each block at home meets the other blocks in one matrix product
in double precision that returns degrees and a spanning forest, never the pairs. Two visitors are never compared.

Cells hold CELL_ROWS vectors on average, and there are LEAST_CELLS at least where there are as many vectors; at most
MOST_CELLS, a quarter of the fitting sample, beyond which cells grow and are dealt into more blocks.

Vectors whose components are equal are one row until the end, so copies do not multiply the work; each such class has a
number of its own, so no hash stands for a vector. Vectors that are null, empty or zero, or hold a null or a non-finite
component, link with nothing; vectors of different lengths never link. An empty table gives no rows. Repeated ids count
as vectors of their own. The representative of a group is its smallest id. Other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import stash, table
from millrace.llm.components import components, forest

THRESHOLD = 0.95
MAX_TRAINING = 8000
CELL_ROWS, LEAST_CELLS, MOST_CELLS = 4000, 8, MAX_TRAINING // 4
BLOCK = 8192


def valid(column: str = "embedding"):
    """Whether a vector takes part: not null, empty or zero, all components finite."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(c) > 0) & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled by the largest component first, so that no square overflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of the lists of a column without nulls."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy()
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, flat[starts[rows][:, None] + np.arange(n)]


def centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1e-300)[:, None], c)
    return c


def _cells(fitted: dict[int, np.ndarray], sine: float):
    """Rows (cell, home, key, copies, vector): each vector at home and where it visits; vector has the column's own bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between: dict[int, np.ndarray] = {}  # distances of the centres, which have length 1, and what rounding may hide
        for batch in it:
            key, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows, raw in by_size(batch.column(2)):
                c = fitted.get(raw.shape[1], np.zeros((1, raw.shape[1])))
                if raw.shape[1] not in between:
                    between[raw.shape[1]] = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0)) + 1e-7
                gaps = between[raw.shape[1]]
                for at in range(0, len(rows), 1024):
                    part = slice(at, at + 1024)
                    near = units(raw[part]) @ c.T
                    own = near.argmax(axis=1)
                    visit = near[np.arange(len(own)), own][:, None] - near <= sine * gaps[own] + 1e-9
                    visit &= np.arange(len(c)) < own[:, None]
                    visit[np.arange(len(own)), own] = True
                    i, cell = np.nonzero(visit)
                    sent = [x.tobytes() for x in raw[part]]
                    yield pa.RecordBatch.from_arrays([pa.array((raw.shape[1] << 32) | cell), pa.array(cell == own[i]), pa.array(key[rows[part]][i]), pa.array(copies[rows[part]][i]), pa.array([sent[k] for k in i], pa.binary())], names=["cell", "home", "key", "copies", "vector"])

    return run


def _products(threshold: float, kind: str):
    """From the rows of one pair of blocks: degrees (key, links) and the edges of a spanning forest (key, other)."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        key, block, copies = (group.column(c).to_numpy() for c in ("key", "block", "copies"))
        x = units(np.frombuffer(b"".join(group.column("vector").to_pylist()), dtype=kind).reshape(len(key), -1))
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        other, near_copies = x[right].T, copies[right]
        degree = np.zeros(len(key), dtype=np.int64)
        a, b = [], []
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            i, j = np.nonzero(x[rows] @ other >= threshold)
            p, q = rows[i], right[j]
            p, q, j = p[p != q], q[p != q], j[p != q]
            np.add.at(degree, p, near_copies[j])
            if low != high:
                np.add.at(degree, q, copies[p])
            if len(p):
                c, d = forest(key[p], key[q])
                a.append(c)
                b.append(d)
        own = np.flatnonzero(degree)
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        return pa.table({"key": np.concatenate([key[own], a]), "other": pa.array(np.concatenate([degree[own], b])), "edge": np.concatenate([np.zeros(len(own), bool), np.ones(len(a), bool)])})

    return run


def _placed(dealt: DataFrame) -> DataFrame:
    """Rows of each pair of blocks (cell, low, high) that is compared: low is a block at home, high any other or itself."""
    count = lambda c: F.ceil(F.sum(F.when(c, 1).otherwise(0)) / F.lit(float(BLOCK))).cast("int")
    sizes = dealt.groupBy("cell").agg(count(F.col("home")).alias("homes"), count(~F.col("home")).alias("guests")).where("homes > 0")
    placed = dealt.join(sizes, "cell")
    block = F.when(F.col("home"), F.pmod(F.xxhash64("key"), F.col("homes"))).otherwise(F.col("homes") + F.pmod(F.xxhash64("key"), F.greatest(F.lit(1), F.col("guests"))))
    last = F.when(F.col("home"), F.col("homes") + F.col("guests") - 1).otherwise(F.col("homes") - 1)
    placed = placed.withColumn("block", block.cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), last)))
    return placed.select("cell", F.least("block", "to").alias("low"), F.greatest("block", "to").alias("high"), "block", "key", "copies", "vector")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding)."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = {"float": "<f4", "double": "<f8"}.get(kind)
    own = F.col("embedding") if kind else F.transform("embedding", lambda x: x.cast("double"))
    named = vectors.select("vec_id", F.when(valid(), own).alias("embedding"))
    good = named.where("embedding is not null")
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = stash(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    sample = classes.orderBy(F.xxhash64("embedding"), "first").limit(MAX_TRAINING).select("embedding").toArrow().column(0)
    rows = classes.count()
    k = max(1, min(MOST_CELLS, max(rows // CELL_ROWS, min(LEAST_CELLS, rows))))
    fitted = {}
    for _, raw in by_size(pa.chunked_array(sample).combine_chunks() if sample.num_chunks != 1 else sample.chunk(0)) if rows else []:
        fitted[raw.shape[1]] = centres(units(raw), min(k, len(raw)))
    dealt = classes.select("key", "copies", "embedding").mapInArrow(_cells(fitted, math.sqrt(1 - threshold**2)), "cell long, home boolean, key long, copies long, vector binary")
    found = _placed(stash(dealt, "cells")).groupBy("cell", "low", "high").applyInArrow(_products(threshold, kind or "<f8"), "key long, other long, edge boolean")
    found = stash(found, "products")
    degree = found.where("not edge").groupBy("key").agg(F.sum("other").alias("links"))
    labels = components(found.where("edge"), "key", "other")
    own = classes.join(degree, "key", "left").join(labels.withColumnRenamed("node", "key"), "key", "left")
    own = own.select("embedding", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "key").alias("component"))
    least = own.groupBy("component").agg(F.min("first").alias("component_id"))
    own = own.join(least, "component").select("embedding", "n_links", "component_id")
    out = good.join(own, "embedding").select("vec_id", "n_links", "component_id")
    alone = named.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
