"""A store of contents by digest: equal contents are stored once, and owners see what they put in under their own keys.

Contents stand in parts of (digest, content), names in parts of (owner, key, digest, size); a later part's name for a
key replaces an earlier one, and a name without a digest deletes it. A manifest lists the parts of one revision, so a
reader never sees half a change. Sweeping marks the digests that a live name reaches and writes these once more; what no
name reaches, and the parts that the new manifest does not list, are deleted.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import remove

MOST_PARTS = 64  # of a manifest; beyond it a change sweeps first
_CONTENTS, _NAMES = "digest string, content binary", "owner string, key string, digest string, size long"


class Store:
    """Batches of changes by one writer at a time: of two writers of one revision the second fails.

    Rows without an owner, a key or a content are passed over. Of several contents for one key in a batch, the one with
    the smallest digest counts.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def revision(self) -> int:
        try:
            found = self.spark.read.schema("revision long").parquet(f"{self.root}/manifests").select("revision").agg(F.max("revision")).head()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0
        return found or 0

    def parts(self) -> list[tuple[int, str, str]]:
        """(place, kind, name) of the current revision's parts, in the order of their writing."""
        now = self.revision()
        if not now:
            return []
        return sorted(tuple(r) for r in self.spark.read.parquet(f"{self.root}/manifests/revision={now}").select("place", "kind", "name").collect())

    def _publish(self, parts: list[tuple[int, str, str]]) -> int:
        now = self.revision() + 1
        self.spark.createDataFrame(parts, "place long, kind string, name string").coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/manifests/revision={now}")
        return now

    def _read(self, parts: list[tuple[int, str, str]], kind: str, schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], f"{schema}, place long")
        for place, own, name in parts:
            if own == kind:
                out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.root}/{kind}/{name}").withColumn("place", F.lit(place)))
        return out

    def names(self) -> DataFrame:
        """(owner, key, digest, size) of all live names."""
        last = self._read(self.parts(), "names", _NAMES).groupBy("owner", "key").agg(F.max_by(F.struct("digest", "size"), "place").alias("x"))
        return last.select("owner", "key", "x.digest", "x.size").where("digest IS NOT NULL")

    def contents(self) -> DataFrame:
        """(digest, content) of all that is stored, reached by a name or not."""
        return self._read(self.parts(), "contents", _CONTENTS).drop("place")

    def _write(self, rows: DataFrame, kind: str) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/{kind}/{name}")
        return name

    def _changed(self, names: DataFrame, contents: DataFrame | None) -> int:
        parts = self.parts()
        if len(parts) + 2 > MOST_PARTS:
            self.sweep()
            parts = self.parts()
        place = max((p for p, _, _ in parts), default=-1) + 1
        if contents is not None:
            known = self._read(parts, "contents", _CONTENTS).select("digest")
            fresh = contents.join(known, "digest", "left_anti").groupBy("digest").agg(F.first("content").alias("content"))  # equal digests, equal contents
            parts.append((place, "contents", self._write(fresh, "contents")))
        parts.append((place, "names", self._write(names, "names")))
        return self._publish(parts)

    def put(self, rows: DataFrame) -> int:
        """Stores rows (owner, key, content); gives the new revision. A content that is there already is not written again."""
        good = rows.where("owner IS NOT NULL AND key IS NOT NULL AND content IS NOT NULL")
        own = good.select("owner", F.col("key").cast("string").alias("key"), F.col("content").cast("binary").alias("content")).withColumn("digest", F.sha2("content", 256))
        names = own.groupBy("owner", "key").agg(F.min(F.struct("digest", F.octet_length("content").cast("long").alias("size"))).alias("x")).select("owner", "key", "x.digest", "x.size")
        named = own.join(names.select("owner", "key", "digest"), ["owner", "key", "digest"], "left_semi")
        return self._changed(names, named.select("digest", "content"))

    def delete(self, keys: DataFrame) -> int:
        """Deletes the names (owner, key); others' and unknown ones are left alone, and contents stay until a sweep."""
        gone = self.names().join(keys.select("owner", F.col("key").cast("string").alias("key")), ["owner", "key"], "left_semi")
        return self._changed(gone.select("owner", "key", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("size")), None)

    def find(self, asked: DataFrame) -> DataFrame:
        """(owner, key, digest, content, reason) for each distinct row asked (owner, key): reason is null, `foreign` where
        only others have the key, whose contents are not handed out, or `missing`."""
        asked = asked.select("owner", F.col("key").cast("string").alias("key")).distinct()
        names = self.names()
        own = asked.join(names.select("owner", "key", "digest"), ["owner", "key"], "left")
        others = names.select("key", F.lit(True).alias("others")).distinct()
        found = own.join(others, "key", "left").join(self.contents(), "digest", "left")
        reason = F.when(F.col("digest").isNotNull(), None).when(F.col("others"), "foreign").otherwise("missing")
        return found.select("owner", "key", "digest", "content", reason.alias("reason"))

    def sweep(self) -> int:
        """Deletes what no live name reaches; gives the number of contents deleted. Not to be run beside a writer."""
        before = self.contents().count()
        live = self.names()
        kept = self.contents().join(live.select("digest").distinct(), "digest", "left_semi")
        old, now = self.parts(), self.revision()
        contents, names = self._write(kept, "contents"), self._write(live, "names")
        self._publish([(0, "contents", contents), (0, "names", names)])
        for _, kind, name in old:
            remove(self.spark, f"{self.root}/{kind}/{name}")
        for revision in range(1, now + 1):
            remove(self.spark, f"{self.root}/manifests/revision={revision}")
        return before - self.contents().count()
