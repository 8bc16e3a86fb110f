"""Audit of how filters interact: every order of five filters, walked by swaps of two neighbours.

What a filter removes depends only on which filters came before it, so each part's documents are first counted by the
set of filters they fail (a mask), with the good and the toxic ones among them. From these cells the number of documents
that survive a set of filters follows for all 32 sets at once. The walk then visits all 120 orders, each one swap of two
neighbouring filters away from the last: only the two steps that changed place are computed again, and each order's
removals are added to the filters' Shapley sums along the way.

Spark does the counting: conditions on the text stand where it is scanned, and only a digest of the text, the id and the
mask move. Copies are counted by their SHA-256 digest, in partial aggregates, so a text of a third of all rows meets
nowhere as rows. A part's cells are at most 32, whatever the number of documents.

Null texts are empty, and a null source is the part of empty strings. Of rows with equal ids none is a copy of the other;
rows without an id copy nothing and are copied by nothing. A document is good (toxic) if any of its labels says so. An
empty table gives no rows; texts are read whole; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

FILTERS = "ABCDE"
GAP = r"[\x20\x09-\x0D]+"
SALTS = 1024  # for rows without an id, which match no label
ROWS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) of docs (doc_id, text, source)."""
    own = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("t"))
    own = own.withColumn("w", F.array_remove(F.split("t", GAP), ""))
    fails = (
        F.size("w") < 50,
        100 * F.size(F.array_distinct("w")).cast("long") < 65 * F.size("w").cast("long"),
        100 * F.regexp_count("t", F.lit("[A-Z]")).cast("long") > 5 * F.length("t").cast("long"),
        F.col("t").rlike("[#$%&*|]"),
    )
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return own.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("t", 256)).alias("digest"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters A to E that they fail."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(0)
    rows = masked(docs).withColumn("salt", salt).join(known.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left").na.fill(0, ["good", "toxic"])
    kind = ["digest", "part", "mask", "good", "toxic"]
    each = rows.groupBy("doc_id", "salt", *kind).agg(F.count("*").alias("n"))
    # of each kind of copies: those with its smallest id, all, and those without an id
    unnamed = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    copies = each.groupBy(*kind).agg(first, unnamed, F.sum("n").alias("n"))
    least = copies.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    told = copies.join(least, "digest")
    original = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = told.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), original.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - original).alias("n")))).alias("x"))
    flat = split.select("part", "good", "toxic", "x.mask", "x.n")
    return flat.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def swaps(n: int) -> Iterator[int]:
    """The left places of the neighbours to swap, one after another, so that all orders of n things are met once each.

    The last thing sweeps through the others from end to end; between two sweeps the others take one step of their own.
    """
    if n < 2:
        return
    inner, down = swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + down  # the sweeping thing stands at the left end after a sweep down
        down = not down


def survivors(counts: np.ndarray) -> np.ndarray:
    """For each set of filters, how many documents fail none of them, from their numbers by mask."""
    total = counts.copy()
    bits = (len(counts) - 1).bit_length()
    for k in range(bits):  # sums over all submasks
        on = np.flatnonzero(np.arange(len(counts)) >> k & 1)
        total[on] += total[on ^ (1 << k)]
    return total[::-1].copy()  # failing none of a set: masks within its complement


class Walk:
    """One part's steps under the current order; swap() computes the two that change."""

    def __init__(self, counts: np.ndarray, filters: str = FILTERS):
        """counts: rows all, good, toxic; columns masks."""
        self.filters = filters
        self.alive = np.stack([survivors(c) for c in counts])
        self.fails = np.array([self.alive[0][0] - self.alive[0][1 << k] for k in range(len(filters))])
        self.alone = counts[0][1 << np.arange(len(filters))]
        self.order = list(range(len(filters)))
        self.before = [sum(1 << f for f in self.order[:k]) for k in range(len(filters))]
        self.steps = [self._step(k) for k in range(len(filters))]

    def _step(self, k: int) -> tuple[int, ...]:
        f, seen = self.order[k], self.before[k]
        left = self.alive[:, seen | 1 << f]
        removed, good, toxic = self.alive[:, seen] - left
        return int(left[0]), int(removed), int(self.fails[f] - removed), int(self.alone[f]), int(good), int(toxic)

    def swap(self, k: int) -> None:
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]
        self.before[k + 1] = self.before[k] | 1 << self.order[k]
        self.steps[k : k + 2] = self._step(k), self._step(k + 1)


def walked(counts: np.ndarray, filters: str = FILTERS) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders."""
    walk, shapley, out = Walk(counts, filters), [0] * len(filters), []

    def note() -> None:
        for f, step in zip(walk.order, walk.steps):
            shapley[f] += step[1]
        out.append((list(walk.order), list(walk.steps)))

    note()
    for k in swaps(len(filters)):
        walk.swap(k)
        note()
    return [("".join(filters[f] for f in order), k + 1, *step, shapley[f]) for order, steps in out for k, (f, step) in enumerate(zip(order, steps))]


def _part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    counts = np.zeros((3, 1 << len(FILTERS)), dtype=np.int64)
    counts[:, rows["mask"].to_numpy()] = rows[["n", "good", "toxic"]].to_numpy().T
    return pd.DataFrame([(key[0], *x) for x in walked(counts)], columns=[c.split()[0] for c in ROWS.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step; see the module."""
    return cells(docs, labels).groupBy("part").applyInPandas(_part, ROWS)


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), tested AS (
  SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM words
), known AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), cells AS (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM tested LEFT JOIN known USING (doc_id) GROUP BY ALL
), steps AS (
  SELECT filter_order, step, list_transform(string_split(filter_order, ''), lambda f: ascii(f) - 64) AS f FROM orders, range(1, 6) AS s(step)
), found AS (
  SELECT part, filter_order, step, f[step] AS own, n, good, toxic, fails[f[step]] AS failing,
    len(list_filter(f[: step - 1], lambda k: fails[k])) AS earlier, len(list_filter(fails, lambda x: x)) AS failed
  FROM cells, steps
), told AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
    CAST(coalesce(sum(n) FILTER (earlier = 0 AND NOT failing), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (earlier = 0 AND failing), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (earlier > 0 AND failing), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (failing AND failed = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (earlier = 0 AND failing), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (earlier = 0 AND failing), 0) AS BIGINT) AS toxic_lost
  FROM found GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM told
"""
