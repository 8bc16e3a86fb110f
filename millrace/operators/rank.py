"""Scores made of named components, and greedy diverse selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def components(rows: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """Adds `parts` (a struct of the components) and `score`, their sum in the order given."""
    total = F.lit(0.0)
    for c in parts.values():
        total = total + c
    return rows.withColumn("parts", F.struct(*[c.cast("double").alias(n) for n, c in parts.items()])).withColumn("score", total)


def _greedy(k: int, penalty: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["score", "id"], ascending=[False, True]).to_dict("records")
        chosen, groups = [], set()
        while rows and len(chosen) < k:
            best = min(rows, key=lambda r: (-(r["score"] - penalty * (r["group_id"] in groups)), r["id"]))
            rows.remove(best)
            chosen.append(best | {"rank": len(chosen) + 1, "score": best["score"] - penalty * (best["group_id"] in groups)})
            if best["group_id"] is not None:
                groups.add(best["group_id"])
        return pd.DataFrame(chosen, columns=["query_id", "id", "rank", "score"])

    return run


def diverse(scored: DataFrame, k: int, penalty: float = 0.12) -> DataFrame:
    """(query_id, id, rank, score): repeatedly the best of (query_id, id, group_id, score), a group already chosen costing a penalty.

    Each pick depends on those before, so a query's candidates meet in one group of at most k * k + k rows that holds
    every possible pick: k picks open at most k groups, in the order of their best rows, and take at most the k best
    rows of each and of the rows without a group. Ties go to the smaller id; a null group never costs anything.
    """
    kind = dict(scored.dtypes)
    own = scored.select("query_id", "id", "group_id", F.col("score").cast("double").alias("score"))
    w = Window.partitionBy("query_id", "group_id").orderBy(F.desc("score"), F.asc("id"))
    best = own.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).withColumn("_first", F.first(F.struct("score", "id")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    of = Window.partitionBy("query_id", F.col("group_id").isNull()).orderBy(F.desc("_first.score"), F.asc("_first.id"), F.asc("group_id"))
    pool = best.withColumn("_place", F.dense_rank().over(of)).where(F.col("_place") <= k)
    return pool.select("query_id", "id", "group_id", "score").groupBy("query_id").applyInPandas(_greedy(k, penalty), f"query_id {kind['query_id']}, id {kind['id']}, rank long, score double")
