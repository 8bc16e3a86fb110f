import pytest

from millrace.operators import index, retrieval
from millrace.sources import tables

SCHEMA = "doc_id long, text string"


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(1, "virtua virtua exit"), (2, "virtua other words"), (3, None), (4, "Exit 日本語 words")], SCHEMA)


@pytest.fixture
def wanted(spark):
    return spark.createDataFrame([(1, "virtua"), (1, "exit"), (2, "nowhere"), (3, "words")], "query_id long, token string")


def same(own, docs, wanted):
    """A kept index answers as a search of the table itself, and has its totals."""
    found = own.index()
    assert rows(retrieval.bm25(found, wanted, 9)) == rows(retrieval.bm25(docs, wanted, 9))
    assert rows(found.statistics) == rows(index.statistics(docs))
    assert rows(own.documents(), "doc_id") == rows(docs, "doc_id")


def test_changes_equal_a_rebuild(spark, tmp_path, docs, wanted):
    own = index.Segments(spark, f"file://{tmp_path}/i", buckets=4)
    with pytest.raises(ValueError, match="no segment"):
        own.index()
    own.delete(docs.where("doc_id = 9"))  # nothing yet
    own.add(docs.where("doc_id < 3"))
    first = own.add(docs.where("doc_id >= 3"))
    same(own, docs, wanted)
    new = spark.createDataFrame([(2, "exit only"), (7, "virtua seven"), (7, "a"), (None, "virtua")], SCHEMA)
    own.add(new)
    after = docs.where("doc_id <> 2").union(spark.createDataFrame([(2, "exit only"), (7, "virtua seven")], SCHEMA))
    same(own, after, wanted)
    own.delete(spark.createDataFrame([(1,), (3,), (99,), (None,)], "doc_id long"))
    left = after.where("doc_id NOT IN (1, 3)")
    same(own, left, wanted)
    own.add(docs.where("doc_id = 1"))  # deleted and added again
    same(own, left.union(docs.where("doc_id = 1")), wanted)
    before = own.merge()
    same(own, left.union(docs.where("doc_id = 1")), wanted)
    assert [m.kind for m in own.manifest()] == ["totals", "segment"]
    own.restore(first)
    same(own, docs, wanted)
    own.restore(before)
    same(own, left.union(docs.where("doc_id = 1")), wanted)
    own.delete(own.documents())
    assert rows(own.index().statistics) == [(0, None)] and own.index().postings.count() == 0


def test_searches_read_live_segments_and_named_partitions_only(spark, tmp_path, docs, wanted):
    own = index.Segments(spark, f"file://{tmp_path}/i", buckets=16)
    own.add(docs)
    old = own.manifest()[1].name
    own.add(docs.where("doc_id > 1"))
    own.delete(docs.where("doc_id = 1"))
    own.merge()
    plan = own.index().find(wanted.where("query_id = 3"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    files = own.index().find(wanted.where("query_id = 3")).inputFiles()
    assert files and not any(old in f for f in files)


def test_sweep_removes_what_no_kept_manifest_names(spark, tmp_path, docs, wanted):
    own = index.Segments(spark, f"file://{tmp_path}/i", buckets=4)
    own.add(docs.where("doc_id = 1"))
    own.add(docs)
    own.merge()
    own.add(docs.where("doc_id = 2"))
    named = {m.name for m in own.manifest() if m.name}
    gone = own.sweep(keep=1)
    assert own.revisions() == [4] and not named & set(gone) and len(gone) == 3  # two segments and the first tombstones
    assert {p.name for p in (tmp_path / "i/segments").iterdir()} | {p.name for p in (tmp_path / "i/tombstones").iterdir()} == named
    same(own, docs, wanted)


def test_two_writers_of_one_revision(spark, tmp_path, docs, monkeypatch):
    own = index.Segments(spark, f"file://{tmp_path}/i", buckets=4)
    own.add(docs)
    monkeypatch.setattr(own, "revisions", lambda: [])
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        own._publish([], 0, 0)


def test_many_parts_merge_first(spark, tmp_path, docs, wanted, monkeypatch):
    monkeypatch.setattr(index, "MOST_PARTS", 4)
    own = index.Segments(spark, f"file://{tmp_path}/i", buckets=2)
    for k in (1, 2, 3, 4):
        own.add(docs.where(f"doc_id = {k}"))
    assert len(own.manifest()) <= 4
    same(own, docs, wanted)


def test_stored_index_is_that_of_the_table_and_condition(spark, tmp_path, docs, wanted, monkeypatch):
    path = f"{tmp_path}/docs"
    docs.write.parquet(path)
    first, again = index.stored(spark, path, buckets=4), index.stored(spark, path, buckets=4)
    assert first.postings.inputFiles() and sorted(first.postings.inputFiles()) == sorted(again.postings.inputFiles())
    assert rows(retrieval.bm25(first, wanted, 5)) == rows(retrieval.bm25(docs, wanted, 5))
    part = index.stored(spark, path, where="doc_id > 1", buckets=4)
    assert rows(retrieval.bm25(part, wanted, 5)) == rows(retrieval.bm25(docs.where("doc_id > 1"), wanted, 5))
    assert rows(retrieval.bm25(index.stored(spark, path, buckets=4), wanted, 5)) == rows(retrieval.bm25(docs, wanted, 5))
    monkeypatch.setattr(index, "MOST_NAMED", 1)
    assert rows(retrieval.bm25(first, wanted, 5)) == rows(retrieval.bm25(docs, wanted, 5))
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 1)  # beyond the bound the batch is joined, not broadcast
    assert rows(retrieval.bm25(first, wanted, 5)) == rows(retrieval.bm25(docs, wanted, 5))
    docs.union(docs).write.mode("overwrite").parquet(path)
    assert rows(retrieval.bm25(index.stored(spark, path, buckets=4), wanted, 9)) == rows(retrieval.bm25(docs.union(docs), wanted, 9))
    for f in index.stored(spark, path, buckets=4).postings.inputFiles():  # cleared by retention
        tables.remove(spark, f.rsplit("/postings", 1)[0])
    assert rows(retrieval.bm25(index.stored(spark, path, buckets=4), wanted, 9)) == rows(retrieval.bm25(docs.union(docs), wanted, 9))


def test_texts_without_tokens(spark, tmp_path, wanted):
    spark.createDataFrame([(1, "!"), (2, None)], SCHEMA).write.parquet(f"{tmp_path}/docs")
    found = index.stored(spark, f"{tmp_path}/docs")
    assert rows(found.statistics) == [(2, 0.0)] and retrieval.bm25(found, wanted, 3).count() == 0


def test_counts_are_made_within_rows(spark, docs):
    from pyspark.sql import functions as F

    own = docs.select("doc_id", F.coalesce(index.tokens("text"), F.array().cast("array<string>")).alias("own"))
    found = index.runs(own, "doc_id")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found, "doc_id", "token", "tf") == rows(index.postings(docs), "doc_id", "token", "tf")


def test_rows_of_one_id_and_length_are_counted_together(spark, tmp_path):
    table = spark.createDataFrame([(1, "aa bb"), (1, "bb cc"), (1, "aa"), (None, "aa"), (None, "aa"), (2, "aa aa")], SCHEMA)
    index.write_segment(table, f"file://{tmp_path}/s", "doc_id", "text", 4)
    found = spark.read.parquet(f"file://{tmp_path}/s/postings").select(index.F.coalesce("doc_id", index.F.lit(0)).alias("doc_id"), "token_count", "token", "tf")
    assert rows(found) == [(0, 1, "aa", 2), (1, 1, "aa", 1), (1, 2, "aa", 1), (1, 2, "bb", 2), (1, 2, "cc", 1), (2, 2, "aa", 2)]


def test_adding_distinct_ids_sorts_no_text(spark, tmp_path, docs, monkeypatch):
    own = index.Segments(spark, f"file://{tmp_path}/i", buckets=4)
    plans = []
    kept = index.write_segment
    monkeypatch.setattr(index, "write_segment", lambda d, *a: (plans.append(d._jdf.queryExecution().executedPlan().toString()), kept(d, *a)))
    own.add(docs)
    own.add(docs.union(docs))
    assert "Sort" not in plans[0] and "Exchange" not in plans[0] and "Sort" in plans[1]
