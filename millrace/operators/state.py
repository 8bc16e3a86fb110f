"""State as rewrites of tables: revisions, upserts, lineage, paging, idempotent claims and permission folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def revisions(changes: DataFrame, keys: list[str], content: str, *order: str, id: str) -> DataFrame:
    """SCD-2: changes whose content differs from the one before become revisions (revision_of_id, status)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    real = changes.withColumn("_old", F.lag(content).over(w)).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | ~F.col(content).eqNullSafe(F.col("_old"))).drop("_old", "_n")
    return real.withColumn("revision_of_id", F.lag(id).over(w)).withColumn("status", F.when(F.lead(id).over(w).isNull(), "active").otherwise("superseded"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` replace those of `old` with equal keys; the rest of both stay."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def descendants(spark, view: str, id: str, parent: str, roots: str) -> DataFrame:
    """(id, depth) of all rows below the roots (a SQL predicate) of a registered view."""
    return spark.sql(f"""WITH RECURSIVE below(id, depth) AS (
        SELECT {id}, CAST(0 AS BIGINT) FROM {view} WHERE {roots}
        UNION ALL SELECT v.{id}, b.depth + 1 FROM {view} v JOIN below b ON v.{parent} = b.id)
        SELECT id, depth FROM below""")


def page(rows: DataFrame, order: str, id: str, n: int, after: tuple | None = None) -> DataFrame:
    """The n newest rows after a cursor (order value, id), and whether more follow (has_more on each row)."""
    if after is not None:
        rows = rows.where((F.col(order) < F.lit(after[0])) | ((F.col(order) == F.lit(after[0])) & (F.col(id) < F.lit(after[1]))))
    found = rows.orderBy(F.desc(order), F.desc(id)).limit(n + 1)
    numbered = found.withColumn("_n", F.row_number().over(Window.orderBy(F.desc(order), F.desc(id))))
    return numbered.withColumn("has_more", F.max("_n").over(Window.partitionBy()) > n).where(F.col("_n") <= n).drop("_n")


def claims(requests: DataFrame, id: str, order: str, hash: str, lease: float) -> DataFrame:
    """The outcome of each request in order: new, conflict (another hash), retry (the lease is over) or held."""
    w = Window.partitionBy(id).orderBy(order)
    first = F.first(hash).over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = F.lag(order).over(w)
    return requests.withColumn("outcome", F.when(last.isNull(), "new").when(first != F.col(hash), "conflict").when(F.col(order) - last > lease, "retry").otherwise("held"))


def last_writer(rows: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """The decision of each key that comes last by layer, time and position."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def clamped_sum(rows: DataFrame, key: str, order: str, delta: Column, start: float = 0.5) -> DataFrame:
    """(key, value): min(1, max(0, .)) after each step in order, folded over a key's ordered steps."""
    steps = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), delta.cast("double").alias("d")))).alias("steps"))
    fold = F.aggregate("steps", F.lit(float(start)), lambda a, x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), a + x["d"])))
    return steps.select(key, F.round(fold, 6).alias("value"))


def revision_digest(rows: DataFrame, key: str, id: str, digest: str, width: int = 1000, levels: int = 3) -> DataFrame:
    """(key, revision, n): a tree of digests over a key's rows in the order of ids (long, 0 or more) and then of digests.

    A node of each of the lower levels covers `width` ids or nodes, whatever their number in the table; the top node
    covers ids / width ** levels nodes. Rows with equal ids are in one node.
    """
    at = rows.select(key, F.col(id).alias("_k"), F.col(digest).alias("_h"), F.lit(1).cast("long").alias("_n"))
    for level in range(levels + 1):
        node = F.expr(f"_k div {width}") if level < levels else F.lit(0)
        ordered = F.array_sort(F.collect_list(F.struct("_k", "_h", "_n")))
        grouped = at.groupBy(key, node.cast("long").alias("_node")).agg(ordered.alias("_x"))
        n = F.aggregate("_x", F.lit(0).cast("long"), lambda s, x: s + x["_n"])
        at = grouped.select(key, F.col("_node").alias("_k"), F.sha2(F.array_join(F.transform("_x", lambda x: x["_h"]), "\n"), 256).alias("_h"), n.alias("_n"))
    return at.select(key, F.col("_h").alias("revision"), F.col("_n").alias("n"))


def append(turns: DataFrame, asked: DataFrame, key: str, order: str, role: str, roles: tuple[str, ...]) -> DataFrame:
    """turns with one row a role appended to each asked key, numbered after its last turn, or from 0 where it has none."""
    last = turns.groupBy(key).agg(F.max(order).alias("_last"))
    each = asked.join(last, key, "left").select(key, F.coalesce("_last", F.lit(-1)).alias("_last"), F.posexplode(F.array(*[F.lit(r) for r in roles])).alias("_at", role))
    kind = dict(turns.dtypes)[order]
    return turns.unionByName(each.select(key, (F.col("_last") + F.col("_at") + 1).cast(kind).alias(order), role))


def rate_limit(events: DataFrame, key: str, at: str, window: int, most: int) -> DataFrame:
    """(key, allowed, refused, windows): an event opens a window where none is open; the first `most` events of each are allowed.

    Where a window opens depends on all before it, so a key's times are folded in order by one task.
    """
    times = events.groupBy(key).agg(F.array_sort(F.collect_list(at)).alias("t"))
    none = F.lit(None).cast("long")
    zero = F.struct(none.alias("opened"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("allowed"), F.lit(0).cast("long").alias("windows"))

    def step(a: Column, t: Column) -> Column:
        new = a["opened"].isNull() | (t >= a["opened"] + window)
        n = F.when(new, F.lit(1).cast("long")).otherwise(a["n"] + 1)
        one = lambda c: F.when(c, 1).otherwise(0).cast("long")
        return F.struct(F.when(new, t).otherwise(a["opened"]).alias("opened"), n.alias("n"), (a["allowed"] + one(n <= most)).alias("allowed"), (a["windows"] + one(new)).alias("windows"))

    done = times.select(key, F.size("t").cast("long").alias("all"), F.aggregate("t", zero, step).alias("a"))
    return done.select(key, "a.allowed", (F.col("all") - F.col("a.allowed")).alias("refused"), "a.windows")
