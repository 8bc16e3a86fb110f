"""Rows out of texts: line slices, sections and dialogue pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_slice(docs: DataFrame, id: str, text: str, first: int, last: int) -> DataFrame:
    """(id, excerpt, start_char): lines `first` to `last` (from 1); start_char is null where the text has fewer lines."""
    lines = F.split(text, "\n")
    before = F.slice(lines, 1, first - 1)
    start = F.aggregate(before, F.lit(0), lambda n, x: n + F.length(x) + 1).cast("long")
    return docs.select(id, F.array_join(F.slice(lines, first, last - first + 1), "\n").alias("excerpt"), F.when(F.size(lines) >= first, start).alias("start_char"))


def sections(docs: DataFrame, id: str, text: str, opens: Callable[[Column], Column]) -> DataFrame:
    """(id, section, lines, chars, body): lines grouped from each line that opens a section; the first line always does."""
    each = docs.select(id, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    w = Window.partitionBy(id).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = each.withColumn("section", F.sum(F.when((F.col("n") == 0) | opens(F.col("line")), 1).otherwise(0)).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return marked.groupBy(id, "section").agg(F.count("*").alias("lines"), F.sum(F.length("line")).cast("long").alias("chars"), body.alias("body"))


def dialogue_pairs(turns: DataFrame, key: str, order: str, role: str, text: str, ask: str = "user", answer: str = "assistant") -> DataFrame:
    """(key, order, prompt, response): a question directly followed by a non-empty answer."""
    w = Window.partitionBy(key).orderBy(order)
    both = turns.select(key, order, role, F.col(text).alias("prompt"), F.lead(role).over(w).alias("_role"), F.lead(text).over(w).alias("response"))
    return both.where((F.col(role) == ask) & (F.col("_role") == answer) & (F.length(F.trim("response")) > 0)).select(key, order, "prompt", "response")
