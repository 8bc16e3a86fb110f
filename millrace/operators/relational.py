"""Small relational helpers that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COMPARE = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a.isin(list(b))}


def filtered(rows: DataFrame, **rules: tuple | None) -> DataFrame:
    """Applies the rules (column, comparison, value) that are given; None stands for no rule."""
    for rule in rules.values():
        if rule is not None:
            column, how, value = rule
            rows = rows.where(_COMPARE[how](F.col(column), value))
    return rows


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that occur more than once; empty where keys are unique."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, state): missing, extra or both."""
    a = expected.select(key).distinct().withColumn("_a", F.lit(True))
    b = found.select(key).distinct().withColumn("_b", F.lit(True))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("both")
    return a.join(b, key, "full").select(key, state.alias("state"))
