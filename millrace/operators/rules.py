"""Rules over records: settings and their overrides, manifests, votes, back-pressure, normalised text and score parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import first_reason


def settings(specs: DataFrame, overrides: DataFrame) -> DataFrame:
    """(name, value, source, reason): each parameter's default, or the value of the one active override that targets it.

    specs: (name, default, low, high); overrides: (override_id, name, value, status) of which only active ones are passed.
    An override that is out of range, names no parameter, or stands beside another for the same parameter has a reason and
    no effect.
    """
    found = overrides.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("override_id", "value")).alias("o"))
    both = specs.join(found, "name", "full")
    reason = first_reason((F.col("n").isNull(), ""), (F.col("default").isNull(), "unknown"), (F.col("n") > 1, "conflict"), (F.col("o.value") < F.col("low"), "below"), (F.col("o.value") > F.col("high"), "above"), (F.lit(True), "override"))
    both = both.withColumn("reason", reason)
    used = F.col("reason") == "override"
    return both.select("name", F.when(used, F.col("o.value")).otherwise(F.col("default")).alias("value"), F.when(used, F.col("o.override_id")).alias("source"), "reason")


def manifest_check(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(name, reason) of every entry that fails: listed but missing, of another digest, or there but not listed."""
    both = manifest.select("name", F.col("sha256").alias("listed")).join(files.select("name", F.col("sha256").alias("found")), "name", "full")
    reason = first_reason((F.col("found").isNull(), "missing"), (F.col("listed").isNull(), "unlisted"), (F.col("found") != F.col("listed"), "changed"))
    return both.select("name", reason.alias("reason")).where("reason is not null")


def vote(votes: DataFrame, new: DataFrame) -> DataFrame:
    """Votes (chat_id, message_id, up, at) after new ones: the last vote on a message in a chat replaces the one it has."""
    every = votes.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.max_by(F.struct("up", "at"), F.struct("_new", "at")).alias("v")
    return every.groupBy("chat_id", "message_id").agg(last).select("chat_id", "message_id", "v.up", "v.at")


def ready_ahead(events: DataFrame, key: str, order: str, made: Column, consumed: Column, most: int = 2) -> DataFrame:
    """Adds `ahead`, what was made and not yet consumed before each row, and `waits`: whether a row that makes one must wait."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(w), F.lit(0))
    ahead = F.greatest(F.lit(0), count(made) - count(consumed)).cast("long")
    return events.withColumn("ahead", ahead).withColumn("waits", made & (F.col("ahead") >= most))


#: How white space is tidied.
TIDY = ((r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"))


def normalised(text, marks: str, keep: str) -> Column:
    """struct(text, replaced): each of the marks becomes a space, but not inside what `keep` matches; white space is tidied.

    Runs of blanks become one, blanks beside a line end go, and more than two line ends become two (TIDY, in turn).
    """
    c = F.trim(F.col(text) if isinstance(text, str) else text)
    spans = F.regexp_extract_all(c, F.lit(f"(?s){keep}|."), F.lit(0))  # protected stretches whole, all else by character
    hit = lambda x: x.rlike(f"^[{marks}]$")
    out = F.array_join(F.transform(spans, lambda x: F.when(hit(x), " ").otherwise(x)), "")
    replaced = F.size(F.filter(spans, hit)).cast("long")
    for pattern, put in TIDY:
        out = F.regexp_replace(out, pattern, put)
    return F.struct(F.trim(out).alias("text"), replaced.alias("replaced"))


#: A flag of an example, and what it adds to the score.
STYLE_FLAGS = {"scene": 0.12, "synthetic": -0.12, "mode": 0.08, "length": 0.05}
#: A measure of an example, and its factor.
STYLE_MEASURES = {"dense": 0.55, "quality": 0.20, "authenticity": 0.15}
#: The share of the penalty that a recent example loses, each expression at its observed rate, and all of them at most.
RECENT_SHARE, EXPRESSION_SHARE, EXPRESSIONS_AT_MOST = 0.5, 0.4, 0.8
#: What the weights of an example's behaviours add, at most, and what a strong expression adds where it is released.
BEHAVIOUR_FACTOR, BEHAVIOURS_AT_MOST, RELEASED = 0.12, 0.18, 0.35


def style_parts(weights: Column) -> dict[str, Column]:
    """The parts of an example's score by name. weights: a map of behaviour -> weight.

    Columns: the flags and measures above; recent (boolean), penalty, behaviours and expressions (arrays), and rates
    (expression -> observed rate). What a map does not name counts as 0.
    """

    def summed(array: str, known) -> Column:
        return F.aggregate(F.transform(array, lambda x: F.coalesce(F.try_element_at(known, x), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)

    parts = {name: F.col(name) * factor for name, factor in STYLE_MEASURES.items()}
    parts |= {name: F.when(F.col(name), factor).otherwise(0.0) for name, factor in STYLE_FLAGS.items()}
    parts["behaviour"] = F.least(F.lit(BEHAVIOURS_AT_MOST), BEHAVIOUR_FACTOR * summed("behaviours", weights))
    penalty = F.col("penalty")
    parts["expression"] = -penalty * F.least(F.lit(EXPRESSIONS_AT_MOST), EXPRESSION_SHARE * summed("expressions", F.col("rates")))
    parts["recent"] = F.when(F.col("recent"), -RECENT_SHARE * penalty).otherwise(0.0)
    released = F.coalesce(F.try_element_at(weights, F.lit("release")) > 0, F.lit(False))
    parts["opportunity"] = F.when(released & F.array_contains("expressions", "strong"), RELEASED).otherwise(0.0)
    return parts


def positions(text, part: str) -> Column:
    """Where a string stands in a text, from 0, without overlaps."""
    c = F.col(text) if isinstance(text, str) else text
    sizes = F.transform(F.split(c, rf"\Q{part}\E", -1), lambda x: F.length(x))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    fold = F.aggregate(F.slice(sizes, 1, F.size(sizes) - 1), zero, lambda a, n: F.struct((a["at"] + n + len(part)).alias("at"), F.concat(a["out"], F.array(a["at"] + n)).alias("out")), lambda a: a["out"])
    return F.when(F.size(sizes) > 1, fold).otherwise(F.array().cast("array<int>"))


def iso_date(text) -> Column:
    """The first date of the form 2024年3月5日 in ISO form, or null."""
    c = F.col(text) if isinstance(text, str) else text
    part = lambda k: F.regexp_extract(c, "([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日", k)
    return F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))
