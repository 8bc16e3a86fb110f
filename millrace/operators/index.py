"""Inverted index: postings, corpus statistics and document frequencies, computed at once or kept up in segments.

A kept index is a folder of immutable parts. A segment holds `postings` (id, token, tf, token_count) in partitions by a
hash of the token, so a search reads the partitions of its tokens only, and `documents` (id, token_count); a batch of
tombstones holds ids whose rows in earlier segments are dead. A manifest names the parts of one revision and carries the
totals of its live documents; the largest revision is current. Adding and deleting write small parts and a new manifest,
merging writes one segment in place of all, and going back to a revision only writes its manifest again.
"""

from __future__ import annotations

import hashlib
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.text import TOKEN, tokens
from millrace.sources.tables import remove, shared_dir

BUCKETS = 64  # partitions of the postings; a parameter of a kept index
MOST_NAMED = 1000  # tokens of a batch that are named to the scan
MOST_PARTS = 64  # of a manifest; beyond it a change merges first


def postings(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(id, token, tf). The count is partial before its one shuffle."""
    return docs.select(id, F.explode(tokens(text, **how)).alias("token")).groupBy(id, "token").agg(F.count("*").alias("tf"))


def lengths(posted: DataFrame, id: str = "doc_id") -> DataFrame:
    return posted.groupBy(id).agg(F.sum("tf").alias("token_count"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("token").agg(F.count("*").alias("df"))


def statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (n, avg_len) over all documents, those without a token included; nothing is exploded or shuffled."""
    n = F.size(tokens(text)).cast("long")
    return docs.agg(F.count("*").alias("n"), F.avg(F.coalesce(n, F.lit(0))).alias("avg_len"))


def bucket_of(token, buckets: int):
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


class Index(NamedTuple):
    postings: DataFrame  # (id, token, tf, token_count, bucket)
    statistics: DataFrame
    buckets: int

    def find(self, queries: DataFrame) -> DataFrame:
        """The postings of the queries' (query_id, token) tokens: only their partitions are read.

        The tokens of a batch of at most MOST_NAMED are named to the scan with their partitions, as postings are sorted by
        token within a file; of a larger batch the partitions are named, and the tokens joined.
        """
        wanted = queries.select("token", bucket_of("token", self.buckets).alias("bucket")).distinct()
        few = wanted.limit(MOST_NAMED + 1).collect()
        if len(few) <= MOST_NAMED:
            return self.postings.where(F.col("bucket").isin({r.bucket for r in few}) & F.col("token").isin([r.token for r in few])).drop("bucket")
        named = [r.bucket for r in wanted.select("bucket").distinct().collect()]  # at most as many as there are buckets
        return self.postings.where(F.col("bucket").isin(named)).join(wanted, ["bucket", "token"], "left_semi").drop("bucket")


def repeated(rows: DataFrame, id: str) -> DataFrame:
    """(_id) of those ids, null among them, that more than one row has."""
    return rows.groupBy(id).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(id).alias("_id"))


def runs(own: DataFrame, *keep: str) -> DataFrame:
    """(keep, token, tf) of rows (keep, own), own an array of tokens: counted within each row, so nothing moves or is held beyond it."""
    sorted_ = own.where(F.size("own") > 0).select(*keep, F.sort_array("own").alias("own"))
    starts = F.filter(F.sequence(F.lit(0), F.size("own") - 1), lambda i: (i == 0) | (F.get("own", i) != F.get("own", i - 1)))
    cut = sorted_.select(*keep, "own", starts.alias("starts"))
    run = lambda i, k: F.struct(F.get("own", i).alias("token"), (F.coalesce(F.get("starts", k + 1), F.size("own")) - i).cast("long").alias("tf"))
    return cut.select(*keep, F.explode(F.transform("starts", run)).alias("_run")).select(*keep, "_run.token", "_run.tf")


def _place(posted: DataFrame, path: str, id: str, buckets: int) -> None:
    """Writes postings (id, token_count, token, tf, bucket) in partitions by bucket, in one shuffle.

    A bucket is dealt by its documents too, so a frequent token's postings are written by many tasks, as several files.
    """
    parts = int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the session's, which grows with the input
    deal = F.pmod(F.xxhash64(id), F.lit(max(1, 2 * parts // buckets)))
    posted.repartition(parts, "bucket", deal).sortWithinPartitions("bucket", "token", id).write.partitionBy("bucket").parquet(path)


def write_segment(docs: DataFrame, path: str, id: str, text: str, buckets: int) -> None:
    """The postings and documents of docs (id, text) below a path.

    Counts are made within a document's row, so postings move once, to where they are written. Only rows whose id another
    row has as well are counted by a shuffle: postings of one id and length are one.
    """
    spark = docs.sparkSession
    own = docs.select(id, tokens(text).alias("own")).select(id, F.coalesce("own", F.array().cast("array<string>")).alias("own")).withColumn("token_count", F.size("own").cast("long"))
    own.select(id, "token_count").write.parquet(f"{path}/documents")
    again = repeated(spark.read.parquet(f"{path}/documents"), id)
    if again.isEmpty():
        posted = runs(own, id, "token_count")
    else:
        same = own[id].eqNullSafe(again["_id"])
        several = own.join(again, same, "left_semi").select(id, "token_count", F.explode("own").alias("token")).groupBy(id, "token_count", "token").agg(F.count("*").alias("tf"))
        posted = runs(own.join(again, same, "left_anti"), id, "token_count").unionByName(several)
    _place(posted.withColumn("bucket", bucket_of("token", buckets)), f"{path}/postings", id, buckets)


_MANIFEST = "place long, kind string, name string, n long, total long, note string"


class Segments:
    """An index kept below a folder: changes by parts, searches over the live rows, and any revision that was not swept.

    Rows without an id are left out. Of several rows with one id in a batch the largest text counts; a null text is empty.
    Adding an id that is live replaces its document. Of two writers of one revision the second fails and may try again.
    """

    def __init__(self, spark: SparkSession, root: str, id: str = "doc_id", text: str = "text", buckets: int = BUCKETS):
        self.spark, self.root, self.id, self.text, self.buckets = spark, root.rstrip("/"), id, text, buckets

    # -- manifests

    def revisions(self) -> list[int]:
        found = _try(lambda: self.spark.read.schema(f"{_MANIFEST}, revision long").parquet(f"{self.root}/manifests").select("revision").distinct().collect())
        return sorted(r.revision for r in found or [])

    def manifest(self, revision: int | None = None) -> list[Row]:
        """The rows of a revision, by default the current one: one for each part, and one with the totals. Empty without any."""
        if revision is None:
            known = self.revisions()
            if not known:
                return []
            revision = known[-1]
        return sorted(self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifests/revision={revision}").collect())

    def _publish(self, parts: list[tuple], n: int, total: int, note: str = "") -> int:
        revision = (self.revisions() or [0])[-1] + 1
        rows = [*parts, (-1, "totals", "", n, total, note)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/manifests/revision={revision}")
        return revision

    # -- live rows

    def _read(self, segment: str, what: str) -> DataFrame:
        """Documents always have a file, postings of texts without a token none: their types are those of the documents."""
        path = f"{self.root}/segments/{segment}"
        documents = self.spark.read.parquet(f"{path}/documents")
        if what == "documents":
            return documents
        types = StructType([documents.schema[self.id], *StructType.fromDDL("token_count long, token string, tf long, bucket int")])
        return self.spark.read.schema(types).parquet(f"{path}/postings")

    def _live(self, what: str, manifest: list[Row]) -> DataFrame | None:
        """The rows of `what` (postings, documents) that no later tombstone kills; None without a segment."""
        parts = [self._read(m.name, what).withColumn("_place", F.lit(m.place)) for m in manifest if m.kind == "segment"]
        dead = [self.spark.read.parquet(f"{self.root}/tombstones/{m.name}").withColumn("_dead", F.lit(m.place)) for m in manifest if m.kind == "tombstones"]
        if not parts:
            return None
        rows, killed = _union(parts), _union(dead)
        if killed is not None:
            last = killed.groupBy(self.id).agg(F.max("_dead").alias("_dead"))
            rows = rows.join(last, self.id, "left").where(F.col("_dead").isNull() | (F.col("_dead") < F.col("_place"))).drop("_dead")
        return rows.drop("_place")

    def documents(self, revision: int | None = None) -> DataFrame:
        """(id, token_count) of the live documents."""
        found = self._live("documents", self.manifest(revision))
        if found is None:
            raise ValueError("no segment is published")
        return found

    def index(self, revision: int | None = None) -> Index:
        """For searches: only segments of the revision are read, and of these the partitions that a search names."""
        manifest = self.manifest(revision)
        posted = self._live("postings", manifest)
        if posted is None:
            raise ValueError("no segment is published")
        n, total = _totals(manifest)
        figures = self.spark.createDataFrame([(n, total / n if n else None)], "n long, avg_len double")
        return Index(posted, figures, self.buckets)

    # -- changes

    def _kill(self, ids: DataFrame, manifest: list[Row]) -> tuple[list[tuple], int, int]:
        """The tombstones of those ids that are live, if any, and these documents' number and tokens."""
        live = self._live("documents", manifest)
        if live is None:
            return [], 0, 0
        name = uuid.uuid4().hex
        path = f"{self.root}/tombstones/{name}"
        live.join(ids, self.id, "left_semi").select(self.id, "token_count").write.parquet(path)
        n, total = self.spark.read.parquet(path).agg(F.count("*"), F.coalesce(F.sum("token_count"), F.lit(0))).head()
        return [("tombstones", name)] if n else [], n, total

    def _changed(self, docs: DataFrame | None, ids: DataFrame, note: str) -> int:
        manifest = self.manifest()
        if len(manifest) + 2 > MOST_PARTS:
            self.merge()
            manifest = self.manifest()
        n, total = _totals(manifest)
        place = max((m.place for m in manifest), default=-1) + 1
        killed, gone, lost = self._kill(ids, manifest)
        parts = [tuple(m) for m in manifest if m.kind != "totals"] + [(place, *k, 0, 0, "") for k in killed]
        if docs is not None:
            name = uuid.uuid4().hex
            write_segment(docs, f"{self.root}/segments/{name}", self.id, self.text, self.buckets)
            new, length = self.spark.read.parquet(f"{self.root}/segments/{name}/documents").agg(F.count("*"), F.coalesce(F.sum("token_count"), F.lit(0))).head()
            parts.append((place + 1, "segment", name, new, length, ""))
            n, total = n + new, total + length
        return self._publish(parts, n - gone, total - lost, note)

    def add(self, docs: DataFrame, note: str = "") -> int:
        """Adds documents, replacing those with the same ids; gives the new revision."""
        own = docs.where(F.col(self.id).isNotNull()).select(self.id, F.coalesce(self.text, F.lit("")).alias(self.text))
        again = repeated(own, self.id)
        ids = own.select(self.id)  # a semi-join's other side, where copies do nothing
        if not again.isEmpty():  # only texts of repeated ids move, and are sorted where they are dealt
            same = own[self.id] == again["_id"]
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            several = own.join(again, same, "left_semi").repartition(parts, self.id).groupBy(self.id).agg(F.max(self.text).alias(self.text))
            own = own.join(again, same, "left_anti").unionByName(several)
        return self._changed(own, ids, note)

    def delete(self, ids: DataFrame, note: str = "") -> int:
        """Deletes the documents of ids (id); unknown ids are passed over."""
        return self._changed(None, ids.select(self.id), note)

    def merge(self, note: str = "") -> int:
        """The live rows of all segments as one, without tombstones."""
        manifest, name = self.manifest(), uuid.uuid4().hex
        path = f"{self.root}/segments/{name}"
        documents, posted = (self._live(what, manifest) for what in ("documents", "postings"))
        if documents is None:
            return self._publish([], 0, 0, note)
        documents.write.parquet(f"{path}/documents")
        _place(posted, f"{path}/postings", self.id, self.buckets)
        n, total = _totals(manifest)
        return self._publish([(0, "segment", name, n, total, "")], n, total, note)

    def restore(self, revision: int, note: str = "") -> int:
        """Makes an earlier revision current again, as a new one; no part is written or read."""
        manifest = self.manifest(revision)
        return self._publish([tuple(m) for m in manifest if m.kind != "totals"], *_totals(manifest), note)

    def sweep(self, keep: int = 2) -> list[str]:
        """Deletes the manifests before the last `keep` and every part that no kept one names; gives the deleted parts.

        Marks first, from the kept manifests, then sweeps. Not to be run beside a writer, whose parts no manifest names yet.
        """
        known = self.revisions()
        kept, old = known[-keep:], known[:-keep]
        marked = {m.name for r in kept for m in self.manifest(r)}
        named = {(m.kind, m.name) for r in old for m in self.manifest(r) if m.kind != "totals" and m.name not in marked}
        for r in old:
            remove(self.spark, f"{self.root}/manifests/revision={r}")
        folders = {"segment": "segments", "tombstones": "tombstones"}
        for kind, name in named:
            remove(self.spark, f"{self.root}/{folders[kind]}/{name}")
        return sorted(name for _, name in named)


def _totals(manifest: list[Row]) -> tuple[int, int]:
    return next(((m.n, m.total) for m in manifest if m.kind == "totals"), (0, 0))


def _union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def stored(spark: SparkSession, path: str, id: str = "doc_id", text: str = "text", where: str | None = None, buckets: int = BUCKETS) -> Index:
    """The kept index of the table of Parquet files at a path, or of its rows that meet `where` (SQL); built where it is missing.

    An index is known by the path, the columns, the condition and the tokenizer's pattern, and carries the name, length
    and time of change of each file it was built from; where these differ, the table is indexed anew as the next revision
    and what the revision before it held is swept. It is announced when it is whole, so no search reads half of one; of
    two builders of one revision the second takes what the first published. Parts that were cleared are built again.
    """
    root = f"{shared_dir(spark)}/index/{hashlib.sha256(repr((path, id, text, where, TOKEN, buckets)).encode()).hexdigest()[:32]}"
    files = spark.read.format("binaryFile").load(path if "*" in path else path.rstrip("/")).select("path", "length", "modificationTime")  # a listing: no content is read
    source = hashlib.sha256(repr(sorted((r.path, r.length, str(r.modificationTime)) for r in files.collect())).encode()).hexdigest()
    own = Segments(spark, root, id, text, buckets)
    if (found := _current(own, source)) is not None:
        return found
    docs = spark.read.parquet(path)
    name = uuid.uuid4().hex
    write_segment((docs.where(where) if where else docs).select(id, text), f"{root}/segments/{name}", id, text, buckets)
    n, total = spark.read.parquet(f"{root}/segments/{name}/documents").agg(F.count("*"), F.coalesce(F.sum("token_count"), F.lit(0))).head()
    try:
        own._publish([(0, "segment", name, n, total, "")], n, total, source)
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
    own.sweep()
    found = _current(own, source)
    if found is None:
        raise RuntimeError(f"the index of {path} changed while it was built")
    return found


def _current(own: Segments, source: str) -> Index | None:
    manifest = _try(own.manifest)
    if not manifest or next(m.note for m in manifest if m.kind == "totals") != source:
        return None
    return _try(own.index)


def _try(read):
    """What read() gives, or None where its path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
