"""Rules as rows over facts as rows: everything that follows, with the rule that gave it, and which value of a conflict holds.

A fact is (entity, attribute, value). A rule fires for an entity when facts meet all its conditions, and gives the entity
another fact. Rounds are semi-naive: only facts that are new are joined with conditions, and only rules that they touch
are counted again, until a round gives nothing new. Rules only add facts, so the end does not depend on any order; where
an attribute has been given several values, the rule of the highest priority decides (ties: the smallest id), and the
others stay in the result as conflicts. What a round found is written in the shared folder before the next one starts.

Rows without an entity or attribute are no facts, a null value meets no condition, and repeated rows count once. A rule
without conditions fires for every entity; of a rule whose conditions are listed twice each counts once. The number of
rounds is at most that of the rules, as every round but the last lets a rule fire for the first time somewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.tables import stash

MOST_BROADCAST = 10_000  # conditions or rules


def _sized(rules: DataFrame) -> DataFrame:
    """Broadcast where it is small; a larger table is joined by a shuffle."""
    return F.broadcast(rules) if rules.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else rules


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def meets(value: str, op: str, bound: str):
    """Whether a fact's value meets a condition: =, <> (as text), >= or < (as numbers)."""
    number = lambda c: F.expr(f"try_cast({c} AS double)")
    return (
        F.when(F.col(op) == "=", F.col(value) == F.col(bound))
        .when(F.col(op) == "<>", F.col(value) != F.col(bound))
        .when(F.col(op) == ">=", number(value) >= number(bound))
        .when(F.col(op) == "<", number(value) < number(bound))
    )


def derive(facts: DataFrame, rules: DataFrame, conditions: DataFrame) -> DataFrame:
    """(entity, attribute, value, rule_id, round, chosen, conflict): each derivation once.

    facts: (entity, attribute, value); rules: (rule_id, priority, attribute, value); conditions: (rule_id, attribute, op,
    value). chosen: the derivation that decides its attribute; conflict: another value of the attribute was derived too.
    """
    known = [stash(facts.where("entity IS NOT NULL AND attribute IS NOT NULL").select("entity", "attribute", F.col("value").cast("string").alias("value")).distinct(), "facts")]
    conditions = conditions.select("rule_id", "attribute", "op", F.col("value").cast("string").alias("bound")).distinct()
    needed = _sized(rules.select("rule_id").distinct().join(conditions.groupBy("rule_id").agg(F.count("*").alias("needed")), "rule_id", "left").na.fill(0, ["needed"]))
    placed = _sized(conditions.withColumn("place", F.xxhash64("attribute", "op", "bound")))
    given = _sized(rules.select("rule_id", "priority", "attribute", F.col("value").cast("string").alias("value")))
    met: list[DataFrame] = []
    fired: list[DataFrame] = []
    delta = known[0]
    while True:
        new = delta.join(placed, "attribute").where(meets("value", "op", "bound")).select("entity", "rule_id", "attribute", "op", "bound").distinct()
        if met:
            new = new.join(_union(met), ["entity", "rule_id", "attribute", "op", "bound"], "left_anti")
        new = stash(new, "met")
        touched = new if not met else new.unionByName(_union(met).join(new.select("entity", "rule_id").distinct(), ["entity", "rule_id"], "left_semi"))
        full = touched.groupBy("entity", "rule_id").agg(F.count("*").alias("n")).join(needed, "rule_id").where("n = needed").select("entity", "rule_id")
        if not fired:  # the first round: rules that ask for nothing
            full = full.unionByName(delta.select("entity").distinct().crossJoin(needed.where("needed = 0").select("rule_id")))
        found = full.join(given, "rule_id").withColumn("round", F.lit(len(fired) + 1))
        found = stash(found, "derived")
        fired.append(found)
        met.append(new)
        if not found.limit(1).count():
            break
        delta = stash(found.select("entity", "attribute", "value").distinct().join(_union(known), ["entity", "attribute", "value"], "left_anti"), "delta")
        known.append(delta)
    every = _union(fired)
    w = Window.partitionBy("entity", "attribute")
    chosen = F.row_number().over(w.orderBy(F.desc("priority"), "rule_id")) == 1
    conflict = ~F.min("value").over(w).eqNullSafe(F.max("value").over(w))
    return every.select("entity", "attribute", "value", "rule_id", "round", chosen.alias("chosen"), conflict.alias("conflict"))
