"""Copies of several tables that belong together: rows are kept by closure over the foreign keys, and published at once.

A condition keeps some rows of some tables; whatever refers to a row that is not kept goes too, so the copy has no
orphan. Tables are visited parents first, each row is decided by semi-joins with its kept parents' keys, and every table
is written once under a new name. Only when all are written, counted and proven to have no orphan does a manifest name
them: one revision, under which a reader finds all tables of one moment, however many exports there are.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import remove


class ForeignKey(NamedTuple):
    child: str
    column: str
    parent: str
    key: str


def parents_first(names: list[str], keys: list[ForeignKey]) -> list[str]:
    """The tables in an order in which each comes after those it refers to; keys that lead in a circle are an error."""
    left, out = sorted(names), []
    while left:
        free = [n for n in left if not any(k.child == n and k.parent in left and k.parent != n for k in keys)]
        if not free:
            raise ValueError(f"foreign keys lead in a circle: {left}")
        out += free
        left = [n for n in left if n not in free]
    return out


def orphans(child: DataFrame, parent: DataFrame, key: ForeignKey) -> DataFrame:
    """Rows of child whose key is not null and names no row of parent."""
    known = parent.select(F.col(key.key).alias("_parent")).where("_parent IS NOT NULL").distinct()
    return child.where(F.col(key.column).isNotNull()).join(known, F.col(key.column) == F.col("_parent"), "left_anti")


class Exports:
    """Revisions of a set of tables below a folder. Of two writers of one revision the second fails; nothing is overwritten."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def export(self, tables: dict[str, DataFrame], keys: list[ForeignKey], where: dict[str, Column | str] | None = None, empty: tuple[str, ...] = ()) -> int:
        """Writes the closure of what `where` keeps of the tables and publishes it; gives its revision.

        Tables in `empty` are copied without rows (run-time state that must not travel), and rows that refer to them
        go, unless their key is null. Keys to tables that are not exported are an error, as they could not be checked;
        a table's key to itself keeps rows whose parent is in the table, as it keeps all or is checked by its own where.
        """
        where = where or {}
        unknown = {*where, *empty, *(n for k in keys for n in (k.child, k.parent))} - {*tables}
        if unknown:
            raise ValueError(f"not among the tables: {sorted(unknown)}")
        name, counts = uuid.uuid4().hex, {}
        kept: dict[str, DataFrame] = {}
        for table in parents_first([*tables], keys):
            rows = tables[table].where(F.lit(False)) if table in empty else tables[table]
            if table in where:
                rows = rows.where(where[table])
            for k in (k for k in keys if k.child == table and k.parent != table):
                known = kept[k.parent].select(F.col(k.key).alias("_parent")).where("_parent IS NOT NULL").distinct()
                whole = rows.join(known, F.col(k.column) == F.col("_parent"), "left_semi")
                rows = whole.unionByName(rows.where(F.col(k.column).isNull()))
            path = f"{self.root}/exports/{name}/{table}"
            rows.write.parquet(path)
            kept[table] = self.spark.read.schema(rows.schema).parquet(path)
            counts[table] = kept[table].count()
        lost = [f"{k.child}.{k.column}" for k in keys if orphans(kept[k.child], kept[k.parent], k).limit(1).count()]
        if lost:
            raise ValueError(f"orphans in {lost}")
        rows = [(name, table, counts[table], kept[table].schema.json()) for table in tables]
        revision = max([0, *self.revisions()]) + 1
        self.spark.createDataFrame(rows, "name string, table string, rows long, kind string").coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/manifests/revision={revision}")
        return revision

    def revisions(self) -> list[int]:
        try:
            found = self.spark.read.schema("name string, revision long").parquet(f"{self.root}/manifests").select("revision").distinct().collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(r.revision for r in found)

    def manifest(self, revision: int | None = None) -> DataFrame:
        """(name, table, rows, kind) of a revision, by default the newest."""
        known = self.revisions()
        if not known:
            raise ValueError("nothing is exported")
        return self.spark.read.parquet(f"{self.root}/manifests/revision={known[-1] if revision is None else revision}")

    def read(self, revision: int | None = None) -> dict[str, DataFrame]:
        from pyspark.sql.types import StructType

        found = self.manifest(revision).collect()
        return {r.table: self.spark.read.schema(StructType.fromJson(json.loads(r.kind))).parquet(f"{self.root}/exports/{r.name}/{r.table}") for r in found}

    def drop(self, revision: int) -> None:
        """Forgets a revision and deletes its tables."""
        names = {r.name for r in self.manifest(revision).collect()}
        remove(self.spark, f"{self.root}/manifests/revision={revision}")
        for name in names:
            remove(self.spark, f"{self.root}/exports/{name}")
