"""Evaluation analytics: percentiles, agreement, pairwise consistency, confusion metrics and bootstrap intervals."""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, gold: Column, guess: Column, *keys: str) -> DataFrame:
    """(keys, tp, fp, fn, precision, recall, f1) with guarded denominators."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    c = rows.groupBy(*keys).agg(count(gold & guess).alias("tp"), count(~gold & guess).alias("fp"), count(gold & ~guess).alias("fn"))
    p = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))
    r = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    return c.withColumn("precision", p).withColumn("recall", r).withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-4), F.col("precision") + F.col("recall")))


def consistency(judgments: DataFrame, case: str, winner: str) -> DataFrame:
    """(case, verdict): the winner that all orientations name, else inconsistent; one orientation alone is incomplete."""
    g = judgments.groupBy(case).agg(F.collect_set(winner).alias("w"), F.count("*").alias("n"))
    return g.select(case, F.when(F.col("n") < 2, "incomplete").when(F.size("w") == 1, F.element_at("w", 1)).otherwise("inconsistent").alias("verdict"))


LEAF, MOST_LEAVES = 4096, 1024  # groups of a leaf, until there are so many leaves; beyond, leaves grow
DRAWN = 1 << 22  # groups that a task draws at once


def _stream(seed: int, *of: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, *of])))


def leaf_draws(sizes: list[int], leaf: int, rounds: int, seed: int) -> np.ndarray:
    """How many of a round's draws fall on a leaf, for all rounds.

    As many groups are drawn in a round as there are, and each draw falls on a leaf in proportion to its size: a
    multinomial, split down a binary tree of the leaves. A node's split is drawn from the node's own seed, so every leaf
    finds its part by walking down from the root, and the leaves' parts add up to the whole without being gathered.
    """
    low, high = 0, len(sizes)
    draws = np.full(rounds, sum(sizes), dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left, total = sum(sizes[low:middle]), sum(sizes[low:high])
        part = _stream(seed, 1, low, high).binomial(draws, left / total if total else 0.0)
        if leaf < middle:
            draws, high = part, middle
        else:
            draws, low = draws - part, middle
    return draws


def _resampled(sizes: list[int], rounds: int, seed: int):
    """From a leaf's rows (leaf, k, s, n): for each round the sums of the groups drawn and their number."""

    def run(group: pa.Table) -> pa.Table:
        leaf = group.column("leaf")[0].as_py()
        rows = np.stack([group.column(c).to_numpy() for c in ("k", "s", "n")])
        rows = rows[:, np.lexsort(rows[::-1])]  # the same order on every run
        draws, rng, out = leaf_draws(sizes, leaf, rounds, seed), _stream(seed, 2, leaf), np.zeros((2, rounds))
        step = max(1, DRAWN // max(1, int(draws.max())))
        for at in range(0, rounds, step):
            own = draws[at : at + step]
            picked = rng.integers(rows.shape[1], size=int(own.sum()))
            place = np.repeat(np.arange(len(own)), own)
            for k in (0, 1):
                out[k, at : at + step] = np.bincount(place, rows[k + 1][picked], len(own))
        return pa.table({"round": np.arange(rounds), "leaf": np.full(rounds, leaf, dtype=np.int32), "s": out[0], "n": out[1], "drawn": draws})

    return run


def resamples(groups: DataFrame, value: str, key: str, rounds: int = 10_000, seed: int = 7, leaf: int = LEAF) -> DataFrame:
    """(round, s, n, drawn): sums and counts of the values of `drawn` groups, drawn with replacement, as many as there are.

    Groups are dealt into leaves by their keys' hash; a leaf of about `leaf` groups is one task's. What leaves hand on is
    a row a round, added in the order of the leaves, so reruns over equal group sums agree to the last bit. A null key is a group of its own.
    """
    per = groups.groupBy(key).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    total = per.count()
    leaves = max(1, min(MOST_LEAVES, -(-total // leaf)))
    dealt = per.select(F.xxhash64(key).alias("h"), F.coalesce(F.col("s"), F.lit(0)).cast("double").alias("s"), F.col("n").cast("double").alias("n"))
    dealt = dealt.select(F.pmod("h", F.lit(leaves)).cast("int").alias("leaf"), F.col("h").cast("double").alias("k"), "s", "n")
    found = {r.leaf: r["count"] for r in dealt.groupBy("leaf").count().collect()}  # at most MOST_LEAVES numbers
    sizes = [found.get(k, 0) for k in range(leaves)]
    drawn = dealt.groupBy("leaf").applyInArrow(_resampled(sizes, rounds, seed), "round long, leaf int, s double, n double, drawn long")
    parts = drawn.groupBy("round").agg(F.array_sort(F.collect_list(F.struct("leaf", "s", "n"))).alias("p"), F.sum("drawn").alias("drawn"))
    added = lambda c: F.aggregate("p", F.lit(0.0), lambda t, x: t + x[c]).alias(c)
    return parts.select("round", added("s"), added("n"), "drawn")


def bootstrap(groups: DataFrame, value: str, key: str, rounds: int = 10_000, seed: int = 7) -> DataFrame:
    """(mean, low, high): a cluster bootstrap over group sums and sizes; the bounds are the values at the places
    floor(.025 rounds) and ceil(.975 rounds) - 1 of the sorted means, counted from 0."""
    per = groups.groupBy(key).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    drawn = resamples(groups, value, key, rounds, seed)
    means = drawn.select(F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("m"))
    low, high = math.floor(0.025 * rounds), math.ceil(0.975 * rounds) - 1
    listed = means.agg(F.array_sort(F.collect_list("m")).alias("m"))  # one number a round
    spread = listed.select(F.get("m", F.lit(low)).alias("low"), F.get("m", F.lit(high)).alias("high"))
    return per.agg((F.sum("s") / F.sum("n")).alias("mean")).crossJoin(spread)


CUTS = 64  # ranges of values that a group is parted into


def percentiles_at(rows: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """(keys, one column a place): the values at 1-based places of each sorted group; places may use n, the group's size.

    Exact. Equal values are counted first. Approximate quantiles part a group's values into ranges of like size; sums over
    a group's few ranges tell in which range each place lies, and only those ranges are sorted. A place beyond a group is
    null; nulls among the keys are a group, and null values count nowhere.
    """
    group = F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], *[F.col(k).isNull() for k in keys])
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c")).withColumn("_g", F.to_json(group))
    shares = [k / CUTS for k in range(1, CUTS)]
    cuts = counted.groupBy("_g").agg(F.percentile_approx(value, shares, 100 * CUTS).alias("_cuts"), F.sum("_c").alias("n"))
    placed = counted.join(cuts.select("_g", "_cuts"), "_g").withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sizes = placed.groupBy("_g", "_b").agg(F.sum("_c").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("_before", F.coalesce(before, F.lit(0)))
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), place.cast("long").alias("_at")) for name, place in places.items()])).alias("_p")
    wanted = cuts.select("_g", named).select("_g", "_p._name", "_p._at").join(sizes, "_g").where((F.col("_at") > F.col("_before")) & (F.col("_at") <= F.col("_before") + F.col("_size")))
    inside = F.sum("_c").over(Window.partitionBy("_g", "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.join(wanted.select("_g", "_b").distinct(), ["_g", "_b"], "left_semi").withColumn("_to", inside)
    at = F.col("_at") - F.col("_before")
    found = ranked.join(wanted, ["_g", "_b"]).where((at <= F.col("_to")) & (at > F.col("_to") - F.col("_c")))
    per = found.groupBy("_g").agg(*[F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in places])
    return counted.select("_g", *keys).distinct().join(per, "_g", "left").drop("_g")
